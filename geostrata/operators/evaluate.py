"""Model evaluation, survival curves and panel health. Global orders use bucketed running totals."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.functions.columns import count_where, is_numeric, ratio, share_where
from geostrata.operators.ranks import quantiles, running_total

# Names that hint at an aggregate or a final value.
LEAK_HINT = r"(rate|ratio|closed|closure|exit|churn|lifetime|total|n_|count|last|final|future|surviv|tenure|dur)"


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    ).withColumn("neg", F.col("n") - F.col("pos"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Rank-sum AUC with average ranks for ties, one row."""
    ranked = running_total(_by_score(df, label, score), "score", {"below": "neg"}, inclusive=False)
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return ranked.agg(ratio(wins, F.sum("pos") * F.sum("neg")).alias("auc"))


def brier_of(label: str, score: str) -> Column:
    """The Brier score as an aggregate."""
    return F.avg(F.pow(F.col(score) - F.col(label), F.lit(2)))


def log_loss_of(label: str, score: str, eps: float = 1e-6) -> Column:
    """The mean log loss as an aggregate, scores kept ``eps`` off 0 and 1."""
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    return F.avg(F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log(1 - p)))


def brier(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.agg(brier_of(label, score).alias("brier"))


def log_loss(df: DataFrame, label: str, score: str, eps: float = 1e-6) -> DataFrame:
    return df.agg(log_loss_of(label, score, eps).alias("log_loss"))


def c_index(df: DataFrame, score: str, duration: str, event: str, ties: str = "none") -> DataFrame:
    """Harrell's C over all pairs (event row, row with a strictly later duration).

    Duration ranks are compared bit by bit: two ranks differ first at exactly one bit, so each
    pair is met at exactly one level, as (event with bit 0, later row with bit 1) under the same
    higher bits. That is log2(#durations) copies of the aggregated rows and no pair is listed.
    ``ties='half'`` credits equal scores with one half.
    """
    d = df.filter(F.col(score).isNotNull() & F.col(duration).isNotNull() & F.col(event).isNotNull()).groupBy(
        F.col(duration).alias("t"), F.col(score).alias("s")
    ).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("e"))
    times = d.select("t").distinct().withColumn("one", F.lit(1))
    order = running_total(times, "t", {"rank": "one"}, inclusive=False).select("t", F.col("rank").cast("long").alias("rank"))
    count = times.count()
    levels = max(1, math.ceil(math.log2(max(count, 2))))
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")
    rows = d.join(order, "t").select("s", "n", "e", "rank", level)
    bit = F.expr("shiftright(rank, level)").bitwiseAND(F.lit(1))
    sides = rows.select(
        "level", F.expr("shiftright(rank, level + 1)").alias("above"), "s",
        F.when(bit == 1, F.col("n")).otherwise(0).alias("later"), F.when(bit == 0, F.col("e")).otherwise(0).alias("ev"),
    ).groupBy("level", "above", "s").agg(F.sum("later").alias("later"), F.sum("ev").alias("ev"))
    ranked = running_total(sides, "s", {"lower": "later"}, by=["level", "above"], inclusive=False)
    groups = sides.groupBy("level", "above").agg((F.sum("later") * F.sum("ev")).alias("pairs"))
    good = F.col("ev") * F.col("lower")
    if ties == "half":
        good = good + F.col("ev") * F.col("later") / 2
    elif ties != "none":
        raise ValueError(f"unknown tie rule: {ties}")
    per = ranked.groupBy("level", "above").agg(F.sum(good).alias("good"))
    return per.join(groups, ["level", "above"]).agg(ratio(F.sum("good"), F.sum("pairs")).alias("c_index"))


def roc_curve(df: DataFrame, label: str, score: str, points: int | None = None) -> DataFrame:
    """True and false positive rate of ``score >= threshold`` with both end points.

    All distinct scores by default; ``points`` takes that many evenly spaced score quantiles.
    """
    counts = _by_score(df, label, score)
    ranked = running_total(counts, "score", {"tp": "pos", "fp": "neg"}, descending=True)
    total = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q")).first()
    rates = ranked.select(
        F.col("score").alias("threshold"), (F.col("tp") / F.lit(max(total["p"] or 0, 1))).alias("tpr"),
        (F.col("fp") / F.lit(max(total["q"] or 0, 1))).alias("fpr"),
    )
    if points:
        probs = [i / (points - 1) for i in range(points)]
        cuts = sorted({v for v in quantiles(df, {score: probs}).values() if v is not None})
        # the rate at a cut is the rate of the smallest score at or above it
        steps = F.array(*[F.lit(v) for v in cuts])
        tagged = rates.withColumn("cut", F.explode(F.filter(steps, lambda v: v <= F.col("threshold"))))
        rates = tagged.groupBy(F.col("cut").alias("threshold")).agg(
            F.min_by("tpr", "threshold").alias("tpr"), F.min_by("fpr", "threshold").alias("fpr"))
    ends = df.sparkSession.createDataFrame([(math.inf, 0.0, 0.0), (-math.inf, 1.0, 1.0)], "threshold double, tpr double, fpr double")
    return rates.unionByName(ends)


def quantile_bin(df: DataFrame, value: str, bins: int) -> Column:
    """Zero-based index of the quantile bin, right-closed with the lowest edge included."""
    q = quantiles(df, {value: [i / bins for i in range(bins + 1)]})
    edges = sorted({q[value, i / bins] for i in range(bins + 1)} - {None})
    inner = edges[1:-1]
    out = F.lit(0)
    for e in inner:
        out = out + F.when(F.col(value) > F.lit(e), 1).otherwise(0)
    return F.when(F.col(value).isNotNull(), out)


def calibration_bins(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    binned = df.withColumn("bin", quantile_bin(df, score, bins))
    return binned.groupBy("bin").agg(F.avg(score).alias("predicted"), F.avg(label).alias("observed"), F.count("*").alias("n"))


def qcut_curve(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Mean of x and y with the standard error of y by quantile bins of x."""
    data = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    binned = data.withColumn("bin", quantile_bin(data, x, bins))
    return binned.groupBy("bin").agg(
        F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"), (F.stddev_samp(y) / F.sqrt(F.count("*"))).alias("y_sem"), F.count("*").alias("n"))


def kaplan_meier(df: DataFrame, duration: str, event: str, by: str | None = None, event_times_only: bool = True) -> DataFrame:
    """Survival steps per group: times with an event, or all positive times."""
    data = df.filter(F.col(duration).isNotNull() & F.col(event).isNotNull())
    if not event_times_only:
        data = data.filter(F.col(duration) > 0)
    group = F.col(by) if by else F.lit("all")
    counts = data.groupBy(group.alias("grp"), F.col(duration).alias("t")).agg(
        F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("events"))
    totals = counts.groupBy("grp").agg(F.sum("n").alias("_total"))
    risk = running_total(counts, "t", {"_before": "n"}, by=["grp"], inclusive=False).join(totals, "grp").withColumn(
        "at_risk", F.col("_total") - F.col("_before"))
    if event_times_only:
        risk = risk.filter("events > 0")
    gone = F.col("events") == F.col("at_risk")
    terms = risk.select("grp", "t", "at_risk", "events").withColumns({
        "_ln": F.when(gone, F.lit(0.0)).otherwise(F.log(1 - F.col("events") / F.col("at_risk"))),
        "_end": F.when(gone, 1).otherwise(0),
    })
    curve = running_total(terms, "t", {"_s": "_ln", "_z": "_end"}, by=["grp"])
    return curve.select("grp", "t", "at_risk", "events", F.when(F.col("_z") > 0, F.lit(0.0)).otherwise(F.exp("_s")).alias("survival"))


def hazard_by_year(dim: DataFrame, first: str, last: str, death: str) -> DataFrame:
    """At risk, closed and closure rate per year, from entry and exit counts (no range join)."""
    end = F.coalesce(death, last).cast("long")
    moves = dim.filter(F.col(first).isNotNull() & end.isNotNull() & (end >= F.col(first))).select(F.inline(F.array(
        F.struct(F.col(first).cast("long").alias("year"), F.lit(1).alias("step"), F.lit(0).alias("closed")),
        F.struct((end + 1).alias("year"), F.lit(-1).alias("step"), F.lit(0).alias("closed")),
    )))
    deaths = dim.filter(F.col(death).isNotNull()).select(F.col(death).cast("long").alias("year"), F.lit(0).alias("step"), F.lit(1).alias("closed"))
    per = moves.unionByName(deaths).groupBy("year").agg(F.sum("step").alias("step"), F.sum("closed").alias("closed"))
    span = dim.agg(F.min(first).cast("long").alias("a"), F.max(end).alias("b")).first()
    spine = dim.sparkSession.range(span["a"], span["b"] + 1).withColumnRenamed("id", "year")
    full = spine.join(per, "year", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("step", "closed")})
    run = running_total(full, "year", {"at_risk": "step"})
    return run.select("year", "at_risk", "closed", ratio(F.col("closed"), F.nullif(F.col("at_risk"), F.lit(0))).alias("rate"))


def exp_coefficients(coefs: DataFrame, prefix: str) -> DataFrame:
    """exp(coefficient) of the terms of one factor, relative to its base level."""
    return coefs.filter(F.col("term").startswith(prefix)).select(
        F.substring("term", len(prefix) + 1, 100).alias("level"), "coef", F.exp("coef").alias("exp_coef"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """Share of positive values at or below each distinct one."""
    counts = df.filter(F.col(value) > 0).groupBy(F.col(value).alias("x")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    return running_total(counts, "x", {"_c": "n"}).select("x", (F.col("_c") / F.lit(total)).alias("share"))


def top_share(df: DataFrame, value: str, part: int = 10) -> DataFrame:
    """Share of the total held by the largest n // part positive values (at least one)."""
    counts = df.filter(F.col(value) > 0).groupBy(F.col(value).alias("x")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n"), F.sum(F.col("x") * F.col("n")).alias("s")).first()
    k = max(1, (total["n"] or 0) // part)
    ranked = running_total(counts, "x", {"_before": "n"}, descending=True, inclusive=False)
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(k) - F.col("_before")))
    return ranked.agg((F.sum(F.col("x") * taken) / F.lit(total["s"])).alias("top_share"))


def risk_histogram(df: DataFrame, score: str, year: str, bins: int = 33) -> DataFrame:
    """Rows per year and equal-width bin of [0, max score]; the maximum falls in the last bin."""
    top = df.agg(F.max(score)).first()[0]
    width = (top or 1.0) / bins
    index = F.least(F.floor(F.col(score) / F.lit(width)), F.lit(bins - 1))
    return df.filter(F.col(score).isNotNull()).groupBy(F.col(year).alias("year"), index.alias("bin")).agg(F.count("*").alias("n"))


# --- panel health ------------------------------------------------------------------------------


def leak_scan(df: DataFrame, entity: str, time: str, limit: int | None = None, min_rows: int = 50, min_entities: int = 10,
              constant: float = 0.95) -> DataFrame:
    """Numeric columns that hardly change inside an entity; suspicious names first. ``limit`` cuts the report only."""
    cols = [f.name for f in df.schema.fields if is_numeric(f) and f.name not in (entity, time)]
    if not cols:
        return df.sparkSession.createDataFrame([], "field string, entity_constant_rate double, name_hint boolean")
    per = df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(
        F.count("*").alias("_n"), *[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in cols])
    row = per.agg(F.count("*").alias("_e"), F.sum("_n").alias("_rows"), *[share_where(F.col(c)).alias(c) for c in cols])
    lines = F.array(*[
        F.struct(F.lit(c).alias("field"), F.round(F.col(c), 4).alias("entity_constant_rate"), F.col(c).alias("_r"),
                 F.lit(bool(re.search(LEAK_HINT, c, re.I))).alias("name_hint"))
        for c in cols
    ])
    kept = row.filter((F.col("_rows") >= min_rows) & (F.col("_e") >= min_entities)).select(F.inline(lines)).filter(F.col("_r") >= constant)
    report = kept.orderBy(F.col("name_hint").desc(), F.col("_r").desc(), "field").drop("_r")
    return report if limit is None else report.limit(limit)


def panel_balance(df: DataFrame, entity: str, time: str) -> DataFrame:
    """Entities per period (least, most), periods per entity, single-period and full-span shares."""
    pairs = df.filter(F.col(entity).isNotNull() & F.col(time).isNotNull()).select(entity, time).distinct()
    per_time = pairs.groupBy(time).agg(F.count("*").alias("_n"))
    per_entity = pairs.groupBy(entity).agg(F.count("*").alias("_k"))
    periods = per_time.agg(F.count("*").alias("periods"), F.min("_n").alias("min_entities"), F.max("_n").alias("max_entities"))
    median = quantiles(per_entity, {"_k": (0.5,)})["_k", 0.5]
    spread = per_entity.groupBy("_k").agg(F.count("*").alias("_m"))  # one row per number of periods
    tag = lambda d: d.withColumn("_one", F.lit(1))
    both = tag(spread).join(tag(periods), "_one").groupBy("periods", "min_entities", "max_entities").agg(
        F.sum("_m").alias("entities"),
        ratio(F.sum(F.when(F.col("_k") <= 1, F.col("_m")).otherwise(0)), F.sum("_m")).alias("single_period_share"),
        ratio(F.sum(F.when(F.col("_k") >= F.col("periods"), F.col("_m")).otherwise(0)), F.sum("_m")).alias("full_span_share"),
    )
    return both.withColumn("periods_per_entity_median", F.lit(median).cast("double"))


def missing_concentration(df: DataFrame, time: str, fields: Sequence[str]) -> DataFrame:
    """Null rate overall and in the worst period, and their ratio, per field."""
    per = df.groupBy(time).agg(F.count("*").alias("_n"), *[count_where(F.col(c).isNull()).alias(c) for c in fields])
    wide = per.agg(
        *[ratio(F.sum(c), F.sum("_n")).alias(f"all_{c}") for c in fields],
        *[F.max(F.when(F.col(time).isNotNull(), F.col(c) / F.col("_n"))).alias(f"worst_{c}") for c in fields],
    )
    lines = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(f"all_{c}").alias("overall"), F.col(f"worst_{c}").alias("worst_period"),
                 F.try_divide(F.col(f"worst_{c}"), F.nullif(F.col(f"all_{c}"), F.lit(0.0))).alias("concentration"))
        for c in fields
    ])
    return wide.select(F.inline(lines))


HEALTH = "key string, level string, value double"


def health_checks(df: DataFrame, roles: dict[str, str | None], kind: str = "panel") -> DataFrame:
    """Rows (key, level, value) of the checks that apply to the table's shape."""
    ent, tim, lat, lon, val = (roles.get(r) for r in ("entity", "time", "lat", "lon", "value"))
    ev = roles.get("event_time")
    aggs, lines = [F.count("*").cast("double").alias("rows")], []

    def line(key, level, value):
        lines.append(F.struct(F.lit(key).alias("key"), level.alias("level"), value.cast("double").alias("value")))

    level = lambda ok, bad: F.when(ok, "ok").otherwise(bad)
    line("scale", level(F.col("rows") >= 500, "warn"), F.col("rows"))
    if lat and lon:
        aggs.append(share_where(F.col(lat).isNull() | F.col(lon).isNull()).alias("geo"))
        line("geo", level(F.col("geo") <= 0.2, "danger"), F.col("geo"))
    panel = kind in ("panel", "repeated_panel")
    if panel and tim:
        t = F.col(tim).try_cast("double")
        aggs.append((F.floor(F.max(t)) - F.floor(F.min(t)) + 1).alias("span"))
        line("span", level(F.col("span") >= 5, "danger"), F.col("span"))
    if panel and ent and tim:
        aggs.append(F.countDistinct(ent).alias("entities"))
        line("key", F.lit("warn"), F.col("entities"))
    if kind == "event_log" and ent:
        aggs.append(F.countDistinct(ent).alias("covered"))
        line("event_log", F.lit("ok"), F.col("covered"))
    if kind == "event_log" and ev:
        aggs.append(share_where(F.try_to_timestamp(F.col(ev).cast("string")).isNotNull()).alias("dated"))
        line("event_time", F.lit("ok"), F.col("dated"))
    if kind == "cross_section":
        line("cross_section", F.lit("ok"), F.col("rows"))
    if kind == "network":
        line("network", F.lit("warn"), F.col("rows"))
    if kind == "unknown":
        line("shape", F.lit("danger"), F.col("rows"))
    if val:
        aggs.append(share_where(F.col(val).try_cast("double").isNull()).alias("outcome"))
        line("outcome", level(F.col("outcome") < 0.1, "warn"), F.col("outcome"))
    out = df.agg(*aggs).select(F.inline(F.array(*lines)))
    if panel and ent and tim:
        bal = panel_balance(df, ent, tim).select(
            F.lit("panel").alias("key"), F.lit("ok").alias("level"), F.col("full_span_share").alias("value"))
        leaks = leak_scan(df, ent, tim).agg(F.count("*").alias("n"), F.coalesce(F.bool_or("name_hint"), F.lit(False)).alias("hint")).filter("n > 0").select(
            F.lit("leakage").alias("key"), F.when(F.col("hint"), "warn").otherwise("ok").alias("level"), F.col("n").cast("double").alias("value"))
        out = out.unionByName(bal).unionByName(leaks)
    return out


def ladder_compare(rows: DataFrame) -> DataFrame:
    """Data sets with the strongest and the weakest autocorrelation (one row per data set)."""
    return rows.agg(
        F.max_by("dataset", "moran_i").alias("strongest"), F.max("moran_i").alias("strongest_i"),
        F.min_by("dataset", "moran_i").alias("weakest"), F.min("moran_i").alias("weakest_i"), F.count("*").alias("datasets"))


def evidence_grade(runs: DataFrame) -> DataFrame:
    """Grade A/B/C of each model run from exogeneity, pre-trend and its size, with reasons."""
    exo, t, ratio_ = F.col("exogenous"), F.abs("pre_trend_t"), F.col("pre_trend_ratio")
    start = F.when(exo.isNull(), 2).when(exo, 1).otherwise(3)
    after_t = F.when(t.isNull(), F.greatest(start, F.lit(2))).when(t >= 1.96, F.least(start + 1, F.lit(3))).otherwise(start)
    score = F.when(ratio_ >= 0.5, F.lit(3)).otherwise(after_t)
    reasons = F.array_compact(F.array(
        F.when(exo.isNull(), "exogeneity unknown").when(exo, "exogenous").otherwise("endogenous"),
        F.when(t.isNull(), "pre-trend unknown").when(t >= 1.96, "pre-trend significant").otherwise("pre-trend acceptable"),
        F.when(ratio_ >= 0.5, "pre-trend close to effect"),
    ))
    grade = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), score)
    return runs.withColumns({"grade": grade, "reasons": F.array_join(reasons, "; ")})
