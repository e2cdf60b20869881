"""Column profiles, top values and outliers. Each table is one or two passes over the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geostrata.functions.columns import count_where, is_numeric, numeric_columns, ratio, share_where
from geostrata.operators.ranks import distinct_counts, quantiles
from geostrata.operators.schema import NULL_MEANING, infer_roles

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _lines(row: DataFrame, structs: Sequence) -> DataFrame:
    """Turn one wide aggregate row into one row per field."""
    return row.select(F.inline(F.array(*structs)))


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Moments, exact quantiles and sign shares of numeric columns, over non-null values."""
    cols = list(columns or numeric_columns(df))
    aggs, q = [], {}
    if approx:
        aggs += [F.percentile_approx(F.col(c).cast("double"), list(QUANTILES), 10_000).alias(f"q_{i}") for i, c in enumerate(cols)]
    else:
        q = quantiles(df, {c: QUANTILES for c in cols})
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [
            F.min(v).alias(f"min_{i}"), F.max(v).alias(f"max_{i}"), F.avg(v).alias(f"mean_{i}"),
            F.stddev_pop(v).alias(f"std_{i}"),
            F.avg(F.when(v.isNotNull(), (v < 0).cast("double"))).alias(f"neg_{i}"),
            F.avg(F.when(v.isNotNull(), (v == 0).cast("double"))).alias(f"zero_{i}"),
        ]

    def at(i, c, j, p):
        return F.get(F.col(f"q_{i}"), F.lit(j)) if approx else F.lit(q[c, p]).cast("double")

    structs = [
        F.struct(
            F.lit(c).alias("field"), *[F.col(f"{s}_{i}").alias(s) for s in ("min", "max", "mean", "std")],
            at(i, c, 3, 0.5).alias("median"),
            *[at(i, c, j, p).alias(f"q{int(round(p * 100)):02d}") for j, p in enumerate(QUANTILES)],
            F.col(f"neg_{i}").alias("negative_rate"), F.col(f"zero_{i}").alias("zero_rate"),
        )
        for i, c in enumerate(cols)
    ]
    return _lines(df.agg(*aggs), structs)


def datetime_range(df: DataFrame, columns: Sequence[str] | None = None, pattern: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    cols = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)])
    row = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("min", F.min), ("max", F.max))])
    return _lines(row, [
        F.struct(F.lit(c).alias("field"), *[F.date_format(f"{n}_{i}", pattern).alias(n) for n in ("min", "max")])
        for i, c in enumerate(cols)
    ])


def column_counts(df: DataFrame, roles: Mapping[str, str] | None = None, approx: bool = False) -> DataFrame:
    """Rows, non-null, null and distinct counts per column."""
    roles = {**infer_roles(df.columns), **(roles or {})}
    cols = df.columns
    types = dict(df.dtypes)
    aggs = [F.count("*").alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"nn_{i}") for i, c in enumerate(cols)]]
    if approx:
        aggs += [F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d_{i}") for i, c in enumerate(cols)]

    def line(i, c):
        out = [
            F.lit(c).alias("field"), F.lit(types[c]).alias("dtype"), F.lit(roles[c]).alias("role"),
            F.col("_n").alias("count"), F.col(f"nn_{i}").alias("non_null"),
            (F.col("_n") - F.col(f"nn_{i}")).alias("null_count"),
            F.coalesce(ratio(F.col("_n") - F.col(f"nn_{i}"), F.col("_n")), F.lit(0.0)).alias("null_rate"),
        ]
        return F.struct(*out, F.col(f"d_{i}").alias("distinct")) if approx else F.struct(*out)

    counts = _lines(df.agg(*aggs), [line(i, c) for i, c in enumerate(cols)])
    if approx:
        return counts
    return counts.join(distinct_counts(df), "field", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))


def null_table(df: DataFrame, roles: Mapping[str, str] | None = None) -> DataFrame:
    """Nulls per column and what they mean for the column's role."""
    roles = {**infer_roles(df.columns), **(roles or {})}
    row = df.agg(F.count("*").alias("_n"), *[count_where(F.col(c).isNull()).alias(f"z_{i}") for i, c in enumerate(df.columns)])
    return _lines(row, [
        F.struct(
            F.lit(c).alias("field"), F.col(f"z_{i}").alias("null_count"),
            F.coalesce(ratio(F.col(f"z_{i}"), F.col("_n")), F.lit(0.0)).alias("null_rate"),
            F.lit(roles[c]).alias("role"), F.lit(NULL_MEANING[roles[c]]).alias("meaning"),
        )
        for i, c in enumerate(df.columns)
    ])


def top_values(df: DataFrame, columns: Sequence[str], n: int = 10) -> DataFrame:
    """Most frequent values per column, ties to the smaller value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = (
        df.select(F.inline(pairs)).filter("value is not null")
        .groupBy("field", "value").agg(F.count("*").alias("n"))
    )
    w = Window.partitionBy("field").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def outliers(df: DataFrame, row_id: str, method: str = "iqr", threshold: float | None = None,
             columns: Sequence[str] | None = None) -> DataFrame:
    """One row per outlying value with the bounds that it breaks.

    The bounds are numbers on the driver, so the second pass is a plain filter that can be pushed
    to the scan. Default threshold 1.5 for ``iqr``, 3 for ``zscore``, 3.5 for ``mad``.
    """
    cols = [c for c in (columns or numeric_columns(df)) if c != row_id]
    t = threshold if threshold is not None else {"iqr": 1.5, "zscore": 3.0, "mad": 3.5}.get(method)
    marks = []
    if method == "iqr":
        q = quantiles(df, {c: (0.25, 0.75) for c in cols})
        for c in cols:
            if q[c, 0.25] is not None:
                spread = t * (q[c, 0.75] - q[c, 0.25])
                lo, hi = q[c, 0.25] - spread, q[c, 0.75] + spread
                v = F.col(c).cast("double")
                marks.append((c, (v < lo) | (v > hi), lo, hi))
    elif method == "zscore":
        row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        for i, c in enumerate(cols):
            if row[f"s{i}"]:
                score = (F.col(c).cast("double") - row[f"m{i}"]) / row[f"s{i}"]
                marks.append((c, F.abs(score) > t, -t, t))
    elif method == "mad":
        med = quantiles(df, {c: (0.5,) for c in cols})
        held = [c for c in cols if med[c, 0.5] is not None]
        gaps = df.select(*[F.abs(F.col(c).cast("double") - med[c, 0.5]).alias(c) for c in held])
        mad = quantiles(gaps, {c: (0.5,) for c in held})
        for c in held:
            if mad[c, 0.5]:
                score = (F.col(c).cast("double") - med[c, 0.5]) * 0.6745 / mad[c, 0.5]
                marks.append((c, F.abs(score) > t, -t, t))
    else:
        raise ValueError(f"unknown outlier method: {method}")
    empty = "field string, row_id long, value double, method string, lower_bound double, upper_bound double"
    if not marks:
        return df.sparkSession.createDataFrame([], empty)
    hits = F.array_compact(F.array(*[
        F.when(cond, F.struct(
            F.lit(c).alias("field"), F.col(c).cast("double").alias("value"), F.lit(method).alias("method"),
            F.lit(float(lo)).alias("lower_bound"), F.lit(float(hi)).alias("upper_bound"),
        ))
        for c, cond, lo, hi in marks
    ]))
    any_hit = marks[0][1]
    for m in marks[1:]:
        any_hit = any_hit | m[1]
    return (
        df.filter(any_hit).select(F.col(row_id).alias("row_id"), F.inline(hits))
        .select("field", "row_id", "value", "method", "lower_bound", "upper_bound")
    )


def outlier_summary(found: DataFrame, rows: int) -> DataFrame:
    return found.groupBy("field").agg(
        F.count("*").alias("outliers"), F.first("lower_bound").alias("lower_bound"),
        F.first("upper_bound").alias("upper_bound"), ratio(F.count("*"), F.lit(rows)).alias("rate"),
    )


def outlier_first_rows(found: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` outliers of each field by row id."""
    w = Window.partitionBy("field").orderBy("row_id")
    return found.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def issue_counts(nulls: DataFrame, outlier_sums: DataFrame, breaches: DataFrame) -> DataFrame:
    """0-3 per field: has nulls, has outliers, has rule violations (report-sized inputs)."""
    o = outlier_sums.select("field", "outliers")
    v = breaches.groupBy("field").agg(F.sum("violations").alias("violations"))
    has = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, 1).otherwise(0)
    return nulls.select("field", "null_count").join(o, "field", "left").join(v, "field", "left").select(
        "field", (has("null_count") + has("outliers") + has("violations")).cast("long").alias("n_issues")
    )


@dataclass
class Profile:
    fields: DataFrame
    numeric: DataFrame
    top: DataFrame
    nulls: DataFrame
    outliers: DataFrame
    summary: DataFrame


def profile_summary(df: DataFrame, outlier_rows: DataFrame) -> DataFrame:
    """Rows, columns, null cells and their share, outlier count: one row."""
    nulls = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    row = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(nulls), F.lit(0)).cast("long").alias("null_cells"))
    hits = outlier_rows.agg(F.count("*").alias("outlier_count")).withColumn("_one", F.lit(1))
    width = len(df.columns)
    return row.withColumn("_one", F.lit(1)).join(hits, "_one").select(
        "rows", F.lit(width).cast("long").alias("columns"), "null_cells",
        F.coalesce(ratio(F.col("null_cells"), F.col("rows") * width), F.lit(0.0)).alias("null_rate"), "outlier_count",
    )


def profile(df: DataFrame, row_id: str, roles: Mapping[str, str] | None = None, method: str = "iqr",
            threshold: float | None = None, top_n: int = 10, approx: bool = False) -> Profile:
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    found = outliers(df, row_id, method, threshold)
    top = top_values(df, text, top_n) if text else df.sparkSession.createDataFrame(
        [], "field string, value string, n long, rank int")
    return Profile(
        column_counts(df, roles, approx), numeric_stats(df, approx=approx), top, null_table(df, roles),
        found, profile_summary(df, found),
    )


def field_report(df: DataFrame, top_n: int = 5) -> DataFrame:
    """After mapping: counts plus min/max/mean/median, or the most frequent values."""
    nums = [f.name for f in df.schema.fields if is_numeric(f)]
    others = [c for c in df.columns if c not in nums]
    out = column_counts(df).drop("role")
    if nums:
        out = out.join(numeric_stats(df, nums).select("field", "min", "max", "mean", "median"), "field", "left")
    if others:
        best = top_values(df, others, top_n).groupBy("field").agg(  # at most top_n rows per field
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda e: e["value"]), "|").alias("top")
        )
        out = out.join(best, "field", "left")
    return out


def key_findings(panel: DataFrame, entity: str, year: str, secondary: str, survival: Sequence[str]) -> DataFrame:
    """First-year duplicates, entities whose second id changes, nulls of survival fields: one row."""
    first = panel.agg(F.min(year)).first()[0]
    opening = panel.filter(F.col(year) == F.lit(first)).groupBy(entity).agg(F.count("*").alias("_n"))
    dup = opening.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("first_year_duplicates"))
    per = panel.groupBy(entity).agg((F.max(secondary) != F.min(secondary)).alias("_changes"))
    changed = per.agg(share_where(F.col("_changes")).alias("changed_share"))
    nulls = panel.agg(*[share_where(F.col(c).isNull()).alias(f"null_{c}") for c in survival])
    tag = lambda d: d.withColumn("_one", F.lit(1))
    return tag(dup).join(tag(changed), "_one").join(tag(nulls), "_one").drop("_one")
