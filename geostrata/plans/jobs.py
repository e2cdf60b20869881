"""Whole jobs: each composes the operators and returns its tables; nothing is written to reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions.columns import as_number, correlation, hex_cell, hex_center, is_numeric
from geostrata.operators import evaluate as E
from geostrata.operators import hazard as H
from geostrata.operators import moran as M
from geostrata.operators import panel as N
from geostrata.operators import rings as G
from geostrata.operators import spatial_reg as S
from geostrata.operators import twfe as T
from geostrata.operators import validate as V
from geostrata.operators import weights as W
from geostrata.operators.clean import CleanPlan, CleanResult, clean
from geostrata.operators.infer import ROLES, detect_shape, infer_mapping
from geostrata.operators.linear import linear_index, ols
from geostrata.operators.mapping import MappingScheme, MapResult, apply_scheme
from geostrata.operators.profile import Profile, profile
from geostrata.operators.skew import hot_key_join
from geostrata.session import cut
from geostrata.sources.readers import load_sources


@dataclass
class WorkflowResult:
    before: Profile
    cleaned: CleanResult
    after: Profile
    compared: DataFrame
    report: DataFrame
    mapped: MapResult | None


def run_workflow(df: DataFrame, row_id: str, roles: Mapping[str, str] | None = None, plan: CleanPlan | None = None,
                 assertions: Iterable = (), scheme: MappingScheme | None = None, order_by: Sequence[str] = (),
                 outlier_method: str = "iqr", threshold: float | None = None) -> WorkflowResult:
    """Profile, clean, profile again, compare, validate and map one table.

    The cleaned table is cut once because the second profile, the checks and the mapping read it.
    """
    before = profile(df, row_id, roles, outlier_method, threshold)
    cleaned = clean(df, plan or CleanPlan(), order_by)
    cleaned.data = cut(cleaned.data)
    after = profile(cleaned.data, row_id, roles, outlier_method, threshold)
    compared = V.compare_profiles(before.nulls, after.nulls, before.outliers, after.outliers)
    report = V.validate(cleaned.data, assertions)
    mapped = apply_scheme(cleaned.data, scheme) if scheme else None
    return WorkflowResult(before, cleaned, after, compared, report, mapped)


@dataclass
class ClosureResult:
    exposure: DataFrame
    did: DataFrame
    twfe: T.Fit
    event_rows: list[tuple]
    event_stats: dict
    cross_section: DataFrame
    spatial: dict = field(default_factory=dict)


def run_closures(panel: DataFrame, dim: DataFrame, entity: str = "entity", time: str = "year", value: str = "value",
                 years: tuple[int, int, int, int] = (1996, 1999, 1999, 2001), k: int = 6, resolution: int = 7,
                 xs: Sequence[str] = ("treat_strength", "log_base", "n_branches")) -> ClosureResult:
    """Spillovers of closures: exposure, difference-in-differences, event study, spatial models."""
    dim = cut(dim.withColumn("cell", hex_cell("lat", "lng", resolution)))
    exposure = G.ring_exposure(dim, entity, keep=["acq_year"])
    located = dim.filter("lat is not null and lng is not null")
    alive = located.filter("acq_year is null")
    events = located.filter("acq_year is not null").withColumnRenamed("acq_year", "event_year")
    counts = G.event_counts(alive, events, entity=entity)
    grown = N.growth(panel, value, entity, time)
    did = cut(N.did_panel(grown, G.first_exposure(counts, entity=entity), alive, entity, time))
    fit = T.twfe(did, "chg_rate", entity, time)
    rows, stats = T.event_study(did, "chg_rate", entity, time)

    t0, t1, w0, w1 = years
    cs = N.cell_cross_section(grown, dim, dim.filter("acq_year is not null"), entity, time, value, t0, t1, (w0, w1))
    lat, lng = hex_center("cell", resolution)
    cs = cut(cs.withColumns({"lat": lat, "lng": lng}))
    weights = cut(W.knn_weights(cs, k, "cell"))
    tests = S.lm_tests(cs, weights, "growth_clip", xs, "cell")
    chosen = S.choose_model(tests)
    models = {"sar": S.sar_2sls(cs, weights, "growth_clip", xs, "cell"), "sem": S.sem_gmm(cs, weights, "growth_clip", xs, "cell")}
    if chosen == "sdm":
        models["sdm"] = S.sar_2sls(cs, weights, "growth_clip", xs, "cell", durbin=True)
    base = ols(cs, "growth_clip", xs)
    resid = cs.withColumn("const", F.lit(1.0)).withColumn("resid", F.col("growth_clip") - linear_index(base.terms, base.beta))
    spatial = {
        "ols": base, "tests": tests, "chosen": chosen, "slx": S.slx(cs, weights, "growth_clip", xs, "cell"), **models,
        "effects": S.split_effects(models, xs[0]),
        "resid_moran": M.moran_inference(resid, weights, "resid", "cell").first().asDict(),
    }
    return ClosureResult(exposure, did, fit, rows, stats, cs, spatial)


@dataclass
class SurvivalResult:
    panel: DataFrame
    logit: H.HazardFit
    test_metrics: dict
    cloglog: H.HazardFit
    shap: DataFrame
    residual_moran: dict


def run_survival(dim: DataFrame, entity: str = "entity", group: str = "bank", panel_start: int = 1995,
                 numeric: Sequence[str] = ("age", "neighbor_count", "lat", "lng"), factors: Sequence[str] = ("year", "class", "tier"),
                 cell_km_resolution: int = 7, moran_k: int = 8, permutations: int = 199) -> SurvivalResult:
    """Risk set, logit and cloglog hazards, contributions and residual autocorrelation."""
    base = dim.withColumn("cell", hex_cell("lat", "lng", cell_km_resolution))
    base = N.local_density(base, "cell")
    tiers = N.group_fragility(base, group, F.col("acq_year").isNotNull()).select(group, "n_branches", "tier", "closed_rate")
    base = hot_key_join(base, tiers, [group], "n_branches", "left").withColumns({
        "class": F.coalesce("class", F.lit("MISSING")), "tier": F.coalesce("tier", F.lit("single"))})
    keep = ["class", "tier", "neighbor_count", "lat", "lng", "n_branches", "closed_rate"]
    panel = cut(N.person_period(base, entity, keep))
    key = [entity, "year"]
    train, test = H.split_rows(panel, key)
    logit = H.fit_logit(train, "event", numeric, factors)
    scored = cut(logit.predict(test.filter(logit.design.known())))
    got = H.metrics(scored, "event")
    got["c_index"] = E.c_index(scored, "risk", "age", "event").first()[0]
    cloglog = H.fit_cloglog(H.keep_events(panel, "event", key), "event", numeric, factors)
    terms = logit.design.terms()
    wide = panel.select(*[c.cast("double").alias(t[0]) for c, t in zip(logit.design.columns(), terms)])
    shap = H.linear_shap(wide, {t[0]: b for t, b in zip(terms, logit.coefs)}, {t[0]: (t[0] if t[1] == "numeric" else t[1]) for t in terms})
    located = logit.predict(panel.filter("lat is not null and lng is not null"))  # all rows, one node per place
    nodes = cut(located.groupBy("lat", "lng").agg(F.min(entity).alias("id"), F.avg(F.col("event") - F.col("risk")).alias("resid")).filter("resid is not null"))
    weights = cut(W.knn_weights(nodes, moran_k))
    moran = M.moran_permutation(nodes, weights, "resid", permutations=permutations, min_nodes=moran_k + 2).first().asDict()
    return SurvivalResult(panel, logit, got, cloglog, shap, moran)


@dataclass
class LadderTier:
    points: int
    cells: DataFrame
    weights_summary: dict
    moran_i: float | None
    lag_corr: float | None
    rings: DataFrame


def run_ladder(points: Mapping[str, DataFrame], resolution: int = 8, top_n: int = 100) -> tuple[dict[str, LadderTier], DataFrame | None]:
    """Cells, weights, lag with Moran's I, and rings, for each data set of (lat, lon, value)."""
    out, rows = {}, []
    for name, pts in points.items():
        good = pts.filter("lat is not null and lon is not null")
        lat, lng = hex_center("cell", resolution)
        cells = cut(
            good.groupBy(hex_cell("lat", "lon", resolution).alias("cell"))
            .agg(F.sum("value").alias("value"), F.count("*").alias("n")).withColumns({"lat": lat, "lng": lng}))
        weights = cut(W.row_standardised(W.contiguity_edges(cells)))
        summary = W.weights_summary(cells, weights, "cell").first().asDict()
        lagged = cut(W.spatial_lag(cells, weights, {"lag": "value"}, "cell"))
        i = M.moran(cells, weights, "value", "cell").first()["moran_i"]
        corr = lagged.agg(correlation("value", "lag")).first()[0]
        total = cells.agg(F.sum("n")).first()[0]
        out[name] = LadderTier(total, lagged, summary, i, corr, G.ring_spillover(cells, top_n=top_n))
        rows.append((name, i))
    if not rows:
        return out, None
    spark = next(iter(points.values())).sparkSession
    return out, E.ladder_compare(spark.createDataFrame(rows, "dataset string, moran_i double"))


def run_analyze(spark: SparkSession, source: DataFrame | Sequence[str], override: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Union the sources, find roles and shape, and run the checks that fit; the user may override roles."""
    bundle = None if isinstance(source, DataFrame) else load_sources(spark, source)
    df = source if bundle is None else cut(bundle.data)  # text is parsed once; a table is read in place
    found = infer_mapping(df)
    roles = {r: found[r] for r in ROLES} | dict(override or {})
    shape = detect_shape(df, roles, found["_stats"])
    return {"data": df, "sources": bundle.sources if bundle else None, "roles": roles, "scores": found["_scores"],
            "shape": shape, "health": E.health_checks(df, roles, shape["kind"])}


def run_refit(df: DataFrame, roles: Mapping[str, str | None], y_col: str | None = None, treat_year: str | None = None, mark: str | None = None,
              strength: str | None = None, exit_col: str | None = None, k: int = 6, method: str = "exact",
              max_group: int | None = None, max_time: int | None = None) -> dict[str, Any]:
    """Panel, two-way effects, event study, support, spatial and risk models on any table.

    A part that cannot be computed is None with a note; the others still run. Failures of the cluster are not caught.
    Group and period effects of the risk model are left out above ``max_group`` and ``max_time`` levels only where
    these are given.
    """
    ent, tim, val = roles.get("entity"), roles.get("time"), roles.get("value")
    out: dict[str, Any] = {"notes": [], "capabilities": {}}

    def attempt(name, fn):
        try:
            out[name] = fn()
        except (ValueError, ArithmeticError, np.linalg.LinAlgError, AnalysisException) as exc:
            out[name] = None
            out["notes"].append(f"{name}: {type(exc).__name__}: {exc}")
        out["capabilities"][name] = out[name] is not None
        return out[name]

    def panel():
        if not (ent and tim):
            raise ValueError("entity and time are needed")
        d = df.withColumn(tim, as_number(tim).cast("long")).filter(F.col(ent).isNotNull() & F.col(tim).isNotNull())
        if not y_col:
            if not val:
                raise ValueError("an outcome is needed")
            d = N.growth_abs(d.withColumn(val, as_number(val)), val, ent, tim)
        else:
            d = d.withColumn("y", as_number(y_col))
        d = cut(d)  # read several times below
        event = None if treat_year or mark else roles.get("event_time")
        return cut(N.assign_treatment(d, ent, tim, treat_year, mark, event, strength))

    def twfe():
        d = out["panel"].select(ent, tim, "y", F.col("post").cast("double").alias("post"), "post_x_strength").filter("y is not null")
        xs = ["post", "post_x_strength"] if strength else ["post"]
        return T.within_ols(d, "y", xs, ent, tim, method)

    def event_study():
        d = out["panel"].withColumn("first_event_year", F.coalesce("first_event_year", F.lit(0.0)))
        return T.event_study(d, "y", ent, tim, method)

    def spatial():
        lat, lon = roles.get("lat"), roles.get("lon")
        if not (lat and lon):
            raise ValueError("coordinates are needed")
        cs = cut(entity_cross_section(out["panel"], ent, lat, lon))
        w = cut(W.knn_weights(cs, k))
        base = ols(cs, "y", ["treated"])
        return {"ols": base, "tests": S.lm_tests(cs, w, "y", ["treated"]), "slx": S.slx(cs, w, "y", ["treated"]),
                "moran": M.moran_inference(cs, w, "y").first().asDict()}

    def risk():
        target = exit_col
        d = df
        if not target:
            if not roles.get("event_time"):
                raise ValueError("an exit column or an event date is needed")
            d = df.withColumn("_exit", F.when(F.try_to_timestamp(F.col(roles["event_time"]).cast("string")).isNotNull(), 1).otherwise(0))
            target = "_exit"
        d = d.withColumn(target, F.when(as_number(target).isNotNull(), (as_number(target) > 0).cast("int"))).filter(F.col(target).isNotNull())
        skip = [c for c in (ent, tim, roles.get("lat"), roles.get("lon"), val) if c]
        used = [f.name for f in d.schema.fields if f.name in (target, roles.get("group"), tim) or is_numeric(f) and f.name not in skip]
        d = cut(d.select(*[F.col(f"`{c}`") for c in used]))  # the design and the fit read it several times
        numeric, factors, dropped = H.risk_design(d, target, skip, roles.get("group"), tim, max_group=max_group, max_time=max_time)
        if dropped:
            out["risk_dropped"] = dropped
        if not numeric:
            raise ValueError("no usable regressors")
        return H.fit_cloglog(d, target, numeric, factors)

    if attempt("panel", panel) is not None:
        attempt("twfe", twfe)
        attempt("event_study", event_study)
        attempt("support", lambda: N.strength_support(out["panel"], ent))
        attempt("spatial", spatial)
    attempt("risk", risk)
    return out


def entity_cross_section(panel: DataFrame, entity: str, lat: str, lon: str) -> DataFrame:
    """Entity means of outcome and coordinates with treatment."""
    return panel.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col("y").isNotNull()).groupBy(F.col(entity).alias("id")).agg(
        F.avg(lat).alias("lat"), F.avg(lon).alias("lng"), F.avg("y").alias("y"), F.max("strength_t0").alias("strength"), F.max("treated").cast("double").alias("treated"))
