"""Discrete-time hazard models: sampling, fitting, scoring and out-of-time evaluation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.functions.columns import is_numeric
from geostrata.functions.tails import normal_two_sided
from geostrata.operators.evaluate import auc, brier_of, log_loss_of
from geostrata.operators.ranks import _order_statistics, distinct_counts, quantiles
from geostrata.operators.twfe import kept_terms
from geostrata.session import cut

MAX_LEVELS = 1000
COEFS = "term string, kind string, level string, coef double, se double, p double, lo double, hi double"


def hash_unit(columns: Sequence[str], seed: int) -> Column:
    """A reproducible 52-bit number per row: the same rows draw the same number on any cluster and in other engines."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")


def keep_events(df: DataFrame, event: str, key: Sequence[str], times: float | None = 2.0, cap: int | None = None,
                seed: int = 42) -> DataFrame:
    """All event rows and ``times`` as many others (or others up to ``cap`` rows in total).

    The others are those with the smallest hash; the cut-off is an order statistic, so nothing is
    sorted globally.
    """
    data = df.withColumn("_h", hash_unit(key, seed))
    n = data.groupBy((F.col(event) == 1).alias("e")).count().collect()
    sizes = {bool(r["e"]): r["count"] for r in n}
    events, others = sizes.get(True, 0), sizes.get(False, 0)
    want = cap - events if cap is not None else int(events * times)
    if want >= others:
        return data.drop("_h")
    if want <= 0:
        return data.filter(F.col(event) == 1).drop("_h")
    pool = data.select(F.when(F.col(event) != 1, F.col("_h")).alias("_h"))
    limit = _order_statistics(pool, {"_h": others}, {"_h": {want - 1}}, 200_000)["_h", want - 1]
    return data.filter((F.col(event) == 1) | (F.col("_h") <= limit)).drop("_h")


def split_rows(df: DataFrame, key: Sequence[str], test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by hash, evenly inside every class."""
    test = hash_unit(key, seed) < test_share * float(1 << 52)
    return df.filter(~test), df.filter(test)


@dataclass
class Design:
    """Numeric terms with their fill values, and factors with their levels (first one is the base)."""

    numeric: list[str]
    fills: dict[str, float]
    levels: dict[str, list[str]]
    scale: dict[str, float] = field(default_factory=dict)

    def terms(self) -> list[tuple[str, str, str]]:
        out = [(c, "numeric", c) for c in self.numeric]
        out += [(f"{c}_{v}", c, v) for c, vs in self.levels.items() for v in vs[1:]]
        return out

    def columns(self) -> list[Column]:
        out = []
        for c in self.numeric:
            v = F.coalesce(F.col(c).cast("double"), F.lit(self.fills[c]))
            out.append(v / self.scale[c] if c in self.scale else v)
        for c, vs in self.levels.items():
            out += [F.when(F.col(c).cast("string") == v, 1.0).otherwise(0.0) for v in vs[1:]]
        return out

    def known(self) -> Column:
        """Rows whose factor levels were all seen in training."""
        out = F.lit(True)
        for c, vs in self.levels.items():
            out = out & F.coalesce(F.col(c).cast("string").isin(vs), F.lit(False))
        return out

    def cells(self, df: DataFrame, event: str) -> DataFrame:
        """``(x array<double>, f array<int>, n, e)``: every distinct row of regressors with its trials and events.

        A binomial likelihood depends on nothing else, so a fit reads these rows instead of the data. ``f`` holds the
        places of the factors' levels, 0 for the base and for a null.
        """
        x = F.array(*self.columns()[:len(self.numeric)]) if self.numeric else F.array().cast("array<double>")
        at = [F.greatest(F.lit(0), F.coalesce(F.array_position(F.array(*map(F.lit, vs)), F.col(c).cast("string")), F.lit(0)) - 1) for c, vs in self.levels.items() if vs]
        f = F.array(*at).cast("array<int>") if at else F.array().cast("array<int>")
        rows = df.filter(F.col(event).isNotNull()).select(x.alias("x"), f.alias("f"), (F.col(event) == 1).cast("double").alias("e"))
        return rows.groupBy("x", "f").agg(F.count("*").cast("double").alias("n"), F.sum("e").alias("e"))


def make_design(df: DataFrame, numeric: Sequence[str], factors: Sequence[str] = (), scaled: bool = False) -> Design:
    """Medians, levels (and spreads) of the training rows."""
    med = quantiles(df, {c: (0.5,) for c in numeric})
    fills = {c: float(med[c, 0.5] or 0.0) for c in numeric}
    levels = {}
    for c in factors:
        got = df.select(F.col(c).cast("string").alias("v")).filter("v is not null").distinct().limit(MAX_LEVELS + 1).collect()
        if len(got) > MAX_LEVELS:
            raise ValueError(f"{c} has too many levels for a factor")
        levels[c] = sorted(r["v"] for r in got)
    scale = {}
    if scaled and numeric:
        row = df.agg(*[F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.lit(fills[c]))).alias(c) for c in numeric]).first()
        scale = {c: row[c] for c in numeric if row[c]}
    return Design(list(numeric), fills, levels, scale)


@dataclass
class HazardFit:
    design: Design
    intercept: float
    coefs: list[float]
    rows: list[tuple]
    stats: dict

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, COEFS)

    def index(self) -> Column:
        out = F.lit(self.intercept)
        for c, b in zip(self.design.columns(), self.coefs):
            out = out + c * F.lit(float(b))
        return out

    def predict(self, df: DataFrame, name: str = "risk") -> DataFrame:
        eta = self.index()
        link = self.stats["link"]
        p = 1 - F.exp(-F.exp(eta)) if link == "cloglog" else 1 / (1 + F.exp(-eta))
        return df.withColumn(name, p)


def _moments(cells: DataFrame, design: Design, link: str, beta: np.ndarray, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, float]:
    """Fisher information, score and log likelihood at ``beta``, in one aggregation: a task sums its cells' products."""
    starts = np.cumsum([1 + len(design.numeric)] + [len(v) - 1 for v in design.levels.values() if v])[:-1]
    sizes = [len(v) - 1 for v in design.levels.values() if v]
    k, plain, (zero, one) = len(beta), 1 + len(design.numeric), weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info, score, like = np.zeros((k, k)), np.zeros(k), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.zeros((batch.num_rows, k))
            x[:, 0] = 1.0
            x[:, 1:plain] = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            level = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            for j, (start, size) in enumerate(zip(starts, sizes)):
                rows = np.flatnonzero(level[:, j])
                x[rows, start + level[rows, j] - 1] = 1.0
            n, e = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            hits, misses = one * e, zero * (n - e)
            eta = np.clip(x @ beta, -700, 700)
            if link == "logit":
                p = 1 / (1 + np.exp(-eta))
                slope = p * (1 - p)
            else:
                grown = np.exp(np.minimum(eta, 30))
                p, slope = -np.expm1(-grown), np.exp(np.minimum(eta, 30) - grown)
            p = np.clip(p, 1e-15, 1 - 1e-15)
            spread = p * (1 - p)
            w = (hits + misses) * slope * slope / spread
            info += (x * w[:, None]).T @ x
            score += x.T @ ((hits - (hits + misses) * p) * slope / spread)
            like += float(hits @ np.log(p) + misses @ np.log1p(-p))
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([info.ravel(), score, [like]])], pa.list_(pa.float64()))], ["m"])

    parts = cells.select("x", "f", "n", "e").mapInArrow(run, "m array<double>")
    rows = parts.select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(k * k + k + 1)
    for i, v in rows:
        flat[i] = v
    return flat[:k * k].reshape(k, k), flat[k * k:-1], float(flat[-1])


def _inverse(info: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Terms with information of their own, and the inverse for them, solved on a common scale."""
    kept = kept_terms(info, np.diag(info))
    size = np.sqrt(np.diag(info)[kept])
    return kept, np.linalg.inv(info[np.ix_(kept, kept)] / np.outer(size, size)) / np.outer(size, size)


def fisher_scoring(cells: DataFrame, design: Design, link: str, ridge: float = 0.0, weights: tuple[float, float] = (1.0, 1.0),
                   max_iter: int = 50, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, dict]:
    """Coefficients (intercept first), their standard errors and ``{n, events, loglik, null_loglik, iterations}``.

    Each step is one pass over the cells. A step that lowers the penalised likelihood is halved. Terms that earlier
    ones explain, or on which the data say nothing (any more, where a level has no events), stand still; their error
    is null. ``weights`` are those of rows without and with the event;
    ``ridge`` is a penalty per unit of weight on all but the intercept.
    """
    size = cells.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("e"), F.lit(0.0))).first()
    n, events, k = size[0], size[1], 1 + len(design.terms())
    hits, misses = weights[1] * events, weights[0] * (n - events)
    total = hits + misses
    if not (hits and misses):
        raise ValueError("events and non-events are needed")
    rate = hits / total
    null = hits * math.log(rate) + misses * math.log(1 - rate)
    free = np.r_[0.0, np.ones(k - 1)] * ridge * total
    beta = np.zeros(k)
    beta[0] = math.log(rate / (1 - rate)) if link == "logit" else math.log(-math.log(1 - rate))
    if start is not None and len(start) == k:
        beta = start.copy()
    info, score, like = _moments(cells, design, link, beta, weights)
    goal, steps = like - free @ (beta * beta) / 2, 0
    for steps in range(1, max_iter + 1):
        move, kept, inverse = np.zeros(k), *_inverse(info + np.diag(free))
        move[kept] = inverse @ (score - free * beta)[kept]
        for half in range(30):
            trial = beta + move / 2 ** half
            info, score, like = _moments(cells, design, link, trial, weights)
            reached = like - free @ (trial * trial) / 2
            if reached >= goal - 1e-9 * (1 + abs(goal)):
                break
        moved = np.abs(trial - beta).max()
        away = moved > 0.05 and abs(reached - goal) <= 1e-12 * (1 + abs(goal))  # a level without events runs off for ever
        done = away or moved <= 1e-9 * (1 + np.abs(trial).max())
        beta, goal = trial, reached
        if done:
            break
    errors, (kept, inverse) = np.full(k, np.nan), _inverse(info + np.diag(free))
    errors[kept] = np.sqrt(np.diag(inverse))
    return beta, errors, {"n": int(n), "events": int(events), "loglik": like, "null_loglik": null, "iterations": steps, "rank": len(kept)}


def _coefficient_rows(design: Design, beta: np.ndarray, errors: np.ndarray) -> list[tuple]:
    terms = [*design.terms(), ("Intercept", "intercept", "Intercept")]
    rows = []
    for (term, kind, level), b, e in zip(terms, [*beta[1:], beta[0]], [*errors[1:], errors[0]]):
        if math.isnan(e):
            rows.append((term, kind, level, float(b), None, None, None, None))
        else:
            b, e = float(b), float(e)
            rows.append((term, kind, level, b, e, normal_two_sided(b / e), b - 1.959963984540054 * e, b + 1.959963984540054 * e))
    return rows


def fit_cloglog(df: DataFrame, event: str, numeric: Sequence[str], factors: Sequence[str] = (), max_iter: int = 50,
                ridge: float = 0.0, start: np.ndarray | None = None) -> HazardFit:
    """Binomial GLM with a complementary log-log link: coefficients, Fisher errors, p, CI, AIC, pseudo-R2."""
    design = make_design(df, numeric, factors)
    beta, errors, got = fisher_scoring(cut(design.cells(df, event)), design, "cloglog", ridge, max_iter=max_iter, start=start)
    rows = _coefficient_rows(design, beta, errors)
    deviance, null = -2 * got["loglik"], -2 * got["null_loglik"]
    stats = {
        "link": "cloglog", "n": got["n"], "aic": deviance + 2 * got["rank"], "deviance": deviance, "null_deviance": null,
        "pseudo_r2": 1 - deviance / null if null else None, "iterations": got["iterations"],
        "significant_positive": sum(1 for r in rows if r[5] is not None and r[5] < 0.05 and r[3] > 0),
        "significant_negative": sum(1 for r in rows if r[5] is not None and r[5] < 0.05 and r[3] < 0),
    }
    return HazardFit(design, float(beta[0]), [float(b) for b in beta[1:]], rows, stats)


def fit_logit(df: DataFrame, event: str, numeric: Sequence[str], factors: Sequence[str] = (), l2: float = 1e-4,
              max_iter: int = 200) -> HazardFit:
    """Balanced, L2-penalised logit on median-filled, spread-scaled numbers and level dummies, with the errors of the
    penalised information of the weighted rows."""
    design = make_design(df, numeric, factors, scaled=True)
    cells = cut(design.cells(df, event))
    n, e = cells.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("e"), F.lit(0.0))).first()
    if not e or e == n:
        raise ValueError("events and non-events are needed")
    beta, errors, got = fisher_scoring(cells, design, "logit", l2, (n / (2 * (n - e)), n / (2 * e)), max_iter)
    rows = _coefficient_rows(design, beta, errors)
    return HazardFit(design, float(beta[0]), [float(b) for b in beta[1:]], rows, {"link": "logit", "n": got["n"], "events": got["events"], "iterations": got["iterations"]})


def risk_design(df: DataFrame, target: str, exclude: Sequence[str], group: str | None = None, time: str | None = None,
                max_numeric: int | None = None, max_group: int | None = None, max_time: int | None = None) -> tuple[list[str], list[str], list[str]]:
    """Usable regressors: varying numbers, then the group and the period; and the names that a given cap leaves out."""
    skip = {*exclude, target, group, time, "__source_file"}
    cand = [f.name for f in df.schema.fields if is_numeric(f) and f.name not in skip and not f.name.startswith("_")]
    facs = [c for c in (group, time) if c]
    levels = {d["field"]: d["distinct"] for d in distinct_counts(df, [*cand, *facs]).collect()} if cand or facs else {}
    spread = df.agg(F.count("*"), *[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in cand]).first()
    numeric = [c for c in cand if levels.get(c, 0) > 2 and (spread[c] or 0) > 0]
    limits = {group: max_group, time: max_time}
    small = [c for c in facs if limits[c] is None or levels.get(c, 0) <= limits[c]]
    kept = numeric if max_numeric is None else numeric[:max_numeric]
    return kept, small, [c for c in [*numeric, *facs] if c not in kept and c not in small]


# --- coefficient tables ------------------------------------------------------------------------


def degenerate_flag(coefs: DataFrame, max_coef: float = 20.0, max_se: float | None = 1e3, max_width: float | None = None) -> DataFrame:
    """Mark coefficients that signal perfect separation."""
    big = F.abs("coef") > max_coef
    cond = big
    if max_se is not None:
        cond = cond | F.coalesce(F.col("se") > max_se, F.lit(False))
    if max_width is not None:
        cond = big & (F.col("hi") - F.col("lo") > max_width)
    return coefs.withColumn("degenerate", F.coalesce(cond, F.lit(False)))


def coef_forest(coefs: DataFrame, time_kind: str = "year", max_width: float = 5.0, level: float = 0.05, top: int = 14) -> DataFrame:
    """Significant, tightly estimated terms other than the time effects; the ``top`` largest."""
    kept = coefs.filter((F.col("kind") != time_kind) & (F.col("p") < level) & (F.col("hi") - F.col("lo") < max_width))
    return kept.orderBy(F.col("coef").desc(), "term").limit(top)


def linear_shap(df: DataFrame, coefs: Mapping[str, float], sources: Mapping[str, str] | None = None) -> DataFrame:
    """Mean |b (x - mean)| per feature, added up over the columns of one source."""
    cols = list(coefs)
    mean = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    row = df.agg(*[F.avg(F.abs((F.col(c) - mean[c]) * float(coefs[c]))).alias(c) for c in cols])
    names = {c: (sources or {}).get(c, c) for c in cols}
    lines = F.array(*[F.struct(F.lit(names[c]).alias("feature"), F.col(c).alias("v")) for c in cols])
    return row.select(F.inline(lines)).groupBy("feature").agg(F.sum("v").alias("mean_abs_shap"))


def score_hazard(df: DataFrame, coefs: Sequence[Mapping], numeric: Sequence[str], factors: Sequence[str] = (), year: str | None = None,
                 years: tuple[int, int] | None = None, degenerate: Mapping[str, Sequence[str]] | None = None,
                 leak: Sequence[str] = ()) -> DataFrame:
    """Hazard, contributions and a version without leaking features for every row of a table.

    ``coefs`` are the model's terms (kind, level, coef) - a model-sized list. Rows outside the
    model's domain get a status and no score.
    """
    known = {(c["kind"], str(c["level"])): float(c["coef"]) for c in coefs}
    base = known.get(("intercept", "Intercept"), 0.0)
    parts: list[tuple[str, Column]] = [("base", F.lit(base))]
    for c in numeric:
        if ("numeric", c) in known:
            parts.append((c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * known["numeric", c]))
    for c in factors:
        pairs = {v: b for (k, v), b in known.items() if k == c}
        effect = F.lit(0.0)
        for v, b in pairs.items():
            effect = F.when(F.col(c).cast("string") == v, F.lit(b)).otherwise(effect)
        parts.append((c, effect))
    eta = F.lit(0.0)
    for _, p in parts:
        eta = eta + p
    held = F.lit(0.0)
    for n, p in parts:
        if n in leak:
            held = held + p
    status = F.lit("ok")
    for c, bad in (degenerate or {}).items():
        status = F.when(F.coalesce(F.col(c).cast("string").isin(list(bad)), F.lit(False)), "degenerate level").otherwise(status)
    if year and years:
        status = F.when(F.col(year).isNull(), "no year").when(~F.col(year).between(*years), "year out of range").otherwise(status)
    ok = F.col("status") == "ok"
    return df.withColumn("status", status).withColumns({
        "eta": F.when(ok, eta), "hazard": F.when(ok, 1 - F.exp(-F.exp(eta))),
        "eta_conservative": F.when(ok, eta - held), "hazard_conservative": F.when(ok, 1 - F.exp(-F.exp(eta - held))),
        "contributions": F.when(ok, F.array(*[F.struct(F.lit(n).alias("name"), p.alias("value")) for n, p in parts])),
    })


def calibrate_intercept(df: DataFrame, score: str, event: str, tolerance: float = 1e-10, max_iter: int = 60) -> float:
    """Intercept at which the mean predicted probability equals the event rate.

    Each step is one average over the data; Newton steps with a bisection safeguard.
    """
    data = df.select(F.col(score).cast("double").alias("s"), F.col(event).cast("double").alias("y")).persist()
    try:
        target = data.agg(F.avg("y")).first()[0]
        lo, hi, x = -20.0, 20.0, 0.0
        for _ in range(max_iter):
            p = 1 / (1 + F.exp(-(F.col("s") + F.lit(x))))
            row = data.agg(F.avg(p).alias("m"), F.avg(p * (1 - p)).alias("d")).first()
            gap = row["m"] - target
            if abs(gap) < tolerance:
                break
            lo, hi = (x, hi) if gap < 0 else (lo, x)
            step = x - gap / row["d"] if row["d"] else math.nan
            x = step if lo < step < hi else (lo + hi) / 2
        return x
    finally:
        data.unpersist()


# --- out of time -------------------------------------------------------------------------------


def metrics(df: DataFrame, event: str, score: str = "risk") -> dict:
    """Rows, events, means, Brier score and log loss in one aggregation, and the AUC."""
    row = df.agg(
        F.count("*").alias("n"), F.sum(event).alias("events"), F.avg(event).alias("event_rate"), F.avg(score).alias("mean_pred"),
        brier_of(event, score).alias("brier"), log_loss_of(event, score).alias("log_loss"),
    ).first().asDict()
    return {**row, "auc": auc(df, event, score).first()[0]}


def _window(train: DataFrame, test: DataFrame, event, key, numeric, factors, seed, start=None):
    fit = fit_cloglog(cut(keep_events(train, event, key, seed=seed)), event, numeric, factors, start=start)
    scored = cut(fit.predict(test.filter(fit.design.known())).select(event, "risk"))
    out = metrics(scored, event)
    out["n_dropped_unseen_level"] = test.count() - out["n"]
    return out, np.array([fit.intercept, *fit.coefs])


def rolling_out_of_time(panel: DataFrame, event: str, year: str, key: Sequence[str], numeric: Sequence[str], factors: Sequence[str] = (),
                        min_train_events: int = 200, min_test_events: int = 20, seed: int = 42) -> tuple[list[dict], dict]:
    """For each year: train on all earlier years, test on the whole year; and the aggregate.

    A window's search starts from the last window's coefficients.
    """
    panel = cut(panel)
    per = panel.groupBy(F.col(year).alias("y")).agg(F.sum(event).alias("e")).orderBy("y").collect()
    rows, before, at = [], 0, None
    for r in per:
        if before >= min_train_events and r["e"] >= min_test_events:
            got, at = _window(panel.filter(F.col(year) < r["y"]), panel.filter(F.col(year) == r["y"]), event, key, numeric, factors, seed, at)
            if got["n"]:
                rows.append({"year": r["y"], **got})
        before += r["e"]
    aucs = [r["auc"] for r in rows if r["auc"] is not None]
    n = sum(r["n"] for r in rows)
    summary = {
        "windows": len(rows), "auc_mean": sum(aucs) / len(aucs) if aucs else None,
        "auc_min": min(aucs, default=None), "auc_max": max(aucs, default=None),
        "brier_weighted": sum(r["brier"] * r["n"] for r in rows) / n if n else None,
    }
    return rows, summary


def holdout(panel: DataFrame, event: str, year: str, split_year: int, key: Sequence[str], numeric: Sequence[str],
            factors: Sequence[str] = (), seed: int = 42) -> dict:
    """Train up to a year, test on everything after it."""
    return _window(panel.filter(F.col(year) <= split_year), panel.filter(F.col(year) > split_year), event, key, numeric, factors, seed)[0]
