"""Assertions, reports and before/after comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.functions.columns import as_number, count_where, ratio, share_where
from geostrata.session import cut

REPORT = (
    "name string, check string, severity string, passed boolean, status string, actual double, "
    "expected string, message string"
)
ROW_CHECKS = ("null_rate_le", "no_negative", "range", "row_count_ge", "row_count_le")
KEY_CHECKS = ("unique", "no_duplicates")


def _measure(spec: Mapping[str, Any]) -> Column:
    """The number that a single-row check looks at."""
    kind, name = spec["check"], spec.get("field")
    if kind == "null_rate_le":
        return F.coalesce(share_where(F.col(name).isNull()), F.lit(0.0))
    if kind == "no_negative":
        return count_where(as_number(name) < 0).cast("double")
    if kind == "range":
        out = F.lit(False)
        if spec.get("min") is not None:
            out = out | (as_number(name) < spec["min"])
        if spec.get("max") is not None:
            out = out | (as_number(name) > spec["max"])
        return count_where(out).cast("double")
    return F.count("*").cast("double")


def _verdict(spec, actual: Column) -> tuple[Column, str]:
    kind = spec["check"]
    if kind in ("null_rate_le", "row_count_le"):
        limit = spec.get("max", 0)
        return actual <= float(limit), f"<= {limit}"
    if kind == "row_count_ge":
        limit = spec.get("min", 0)
        return actual >= float(limit), f">= {limit}"
    return actual == 0, "0"


def surplus_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key, one row; nulls are equal."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("double").alias("actual")
    )


def validate(df: DataFrame, assertions: Iterable[Mapping[str, Any] | Callable]) -> DataFrame:
    """A report row per assertion. All single-row checks share one aggregation."""
    items = list(assertions)
    spark = df.sparkSession
    parts: list[DataFrame] = []
    ready: list[tuple] = []

    def row(spec, actual, passed, expected, message=F.lit("")):
        info = bool(spec.get("info"))
        status = F.lit("info") if info else F.when(passed, "pass").otherwise("fail")
        return [
            F.lit(spec.get("name", spec.get("check"))).alias("name"), F.lit(spec.get("check")).alias("check"),
            F.lit(spec.get("severity", "P2")).alias("severity"), passed.alias("passed"), status.alias("status"),
            actual.alias("actual"), F.lit(expected).alias("expected"), message.alias("message"),
        ]

    single = [(i, s) for i, s in enumerate(items) if not callable(s) and s["check"] in ROW_CHECKS]
    if single:
        wide = df.agg(*[_measure(s).alias(f"m{i}") for i, s in single])
        structs = []
        for i, s in single:
            passed, expected = _verdict(s, F.col(f"m{i}"))
            structs.append(F.struct(*row(s, F.col(f"m{i}"), passed, expected)))
        parts.append(wide.select(F.inline(F.array(*structs))))
    for s in items:
        if callable(s):
            name = getattr(s, "__name__", "custom")
            try:
                ok, text = s(df)
            except Exception as exc:  # a broken check must not pass
                ok, text = False, str(exc)
            ready.append((name, "custom", "P2", bool(ok), "pass" if ok else "fail", None, "", text))
            continue
        kind = s["check"]
        if kind in ROW_CHECKS:
            continue
        if kind in KEY_CHECKS:
            keys = [s["field"]] if kind == "unique" else list(s.get("subset") or df.columns)
            one = surplus_rows(df, keys)
            parts.append(one.select(*row(s, F.col("actual"), F.col("actual") == 0, "0")))
        elif kind == "allowed_values":
            bad = (
                df.filter(F.col(s["field"]).isNotNull() & ~F.col(s["field"]).isin(list(s.get("values", []))))
                .select(F.col(s["field"]).cast("string").alias("v")).distinct()
            )
            one = bad.agg(F.count("*").cast("double").alias("actual"), F.min("v").alias("least"))
            parts.append(one.select(*row(s, F.col("actual"), F.col("actual") == 0, "0", F.coalesce("least", F.lit("")))))
        elif kind in ("column_count_eq", "columns_eq"):
            if kind == "column_count_eq":
                actual, wanted = float(len(df.columns)), str(s["value"])
                ok = len(df.columns) == s["value"]
            else:
                gap = set(df.columns) ^ set(s["columns"])
                actual, wanted, ok = float(len(gap)), "0", not gap
            ready.append((s.get("name", kind), kind, s.get("severity", "P2"), ok, "pass" if ok else "fail", actual, wanted, ""))
        else:
            ready.append((s.get("name", kind), kind, s.get("severity", "P2"), False, "fail", None, "", f"unknown check: {kind}"))
    if ready:
        parts.append(spark.createDataFrame(ready, REPORT))
    if not parts:
        return spark.createDataFrame([], REPORT)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report_summary(report: DataFrame) -> DataFrame:
    """Totals by result and whether any failed P0 check blocks the next step."""
    failed = F.col("status") == "fail"
    return report.agg(
        F.count("*").alias("total"), count_where(F.col("status") == "pass").alias("passed"),
        count_where(failed).alias("failed"),
        *[count_where(failed & (F.col("severity") == s)).alias(f"failed_{s.lower()}") for s in ("P0", "P1", "P2")],
        F.coalesce(F.bool_or(failed & (F.col("severity") == "P0")), F.lit(False)).alias("blocking"),
    )


def build_assertions(config: Iterable[Mapping[str, Any]], custom: Mapping[str, Callable] | None = None) -> list:
    """Checks from configuration; a custom check nobody registered fails instead of passing."""
    out = []
    for item in config:
        if item.get("check") != "custom":
            out.append(dict(item))
            continue
        fn = (custom or {}).get(item["name"])

        def run(df, fn=fn, item=item):
            if fn is None:
                return False, f"no function for custom check {item['name']}"
            return fn(df)

        run.__name__ = item["name"]
        out.append(run)
    return out


# --- comparison --------------------------------------------------------------------------------


def compare_profiles(before_nulls, after_nulls, before_outliers, after_outliers) -> DataFrame:
    """Null rates and outlier counts per field before and after; a removed field has nulls after.

    All inputs are report tables with one row per field.
    """
    counts = lambda d, n: d.groupBy("field").agg(F.count("*").alias(n))
    b = before_nulls.select("field", F.col("null_rate").alias("null_rate_before"))
    a = after_nulls.select("field", F.col("null_rate").alias("null_rate_after"))
    out = (
        b.join(a, "field", "left")
        .join(counts(before_outliers, "_ob"), "field", "left").join(counts(after_outliers, "_oa"), "field", "left")
    )
    return out.select(
        "field", "null_rate_before", "null_rate_after",
        (F.col("null_rate_after") - F.col("null_rate_before")).alias("null_rate_diff"),
        F.coalesce("_ob", F.lit(0)).alias("outliers_before"),
        F.when(F.col("null_rate_after").isNotNull(), F.coalesce("_oa", F.lit(0))).alias("outliers_after"),
    )


def advice(compared: DataFrame, removed_rate: float | None, max_removed_rate: float = 0.05,
           key_fields: Sequence[str] = ()) -> str:
    """Go on, or clean again more gently."""
    bad_keys = compared.filter(F.col("field").isin(list(key_fields)) & (F.col("null_rate_after") > 0)).count() if key_fields else 0
    if bad_keys or removed_rate is not None and removed_rate > max_removed_rate:
        return "redo"
    return "continue"


def compare_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Join two field tables (field, dtype, null_rate, distinct, mean, median) side by side."""
    cols = ("dtype", "null_rate", "distinct", "mean", "median")
    b = before.select("field", *[F.col(c).alias(f"{c}_before") for c in cols])
    a = after.select("field", *[F.col(c).alias(f"{c}_after") for c in cols])
    return b.join(a, "field", "full_outer").withColumn("mean_diff", F.col("mean_after") - F.col("mean_before"))


def required_nulls(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Required fields that still hold nulls."""
    row = df.agg(*[share_where(F.col(c).isNull()).alias(c) for c in fields])
    lines = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("null_rate")) for c in fields])
    return row.select(F.inline(lines)).filter("null_rate > 0")


def recommendations(stats: DataFrame, report: DataFrame, required: DataFrame, fills: DataFrame,
                    left_outliers: DataFrame, drop_limit: float = 0.05, fill_limit: float = 0.5) -> DataFrame:
    """Advice rows by severity from the reports (all of them a few rows).

    ``fills`` is (field, fill_rate); ``left_outliers`` is (field, level, outliers).
    """
    cols = lambda sev, item, number: [sev.alias("severity"), item.alias("item"), number.cast("double").alias("evidence")]
    removed = ratio(F.col("removed_rows"), F.col("before_rows"))
    parts = [
        stats.filter(removed > drop_limit).select(*cols(F.lit("P1"), F.lit("many rows removed"), removed)),
        report.filter("status = 'fail'").select(*cols(F.col("severity"), F.concat(F.lit("failed: "), "name"), F.col("actual"))),
        required.select(*cols(F.lit("P0"), F.concat(F.lit("still null: "), "field"), F.col("null_rate"))),
        fills.filter(F.col("fill_rate") > fill_limit).select(*cols(F.lit("P1"), F.concat(F.lit("mostly filled: "), "field"), F.col("fill_rate"))),
        left_outliers.filter(F.col("level").isin("required", "important") & (F.col("outliers") > 0)).select(
            *cols(F.lit("P2"), F.concat(F.lit("outliers left: "), "field"), F.col("outliers"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- checks on entity tables -------------------------------------------------------------------


def renumbered_share(dim: DataFrame, first: str, last: str, closed: Column | None = None) -> DataFrame:
    """Share of entities, and of closed ones, whose second id differs first versus last."""
    differs = F.col(first) != F.col(last)
    aggs = [share_where(differs).alias("share")]
    if closed is not None:
        aggs.append(F.avg(F.when(closed, F.coalesce(differs, F.lit(False)).cast("double"))).alias("share_closed"))
    return dim.agg(*aggs)


def vocabulary_share(df: DataFrame, name: str, allowed: Sequence[str]) -> DataFrame:
    """Rows and share per upper-trimmed code, with a flag for known codes."""
    code = F.upper(F.trim(F.col(name)))
    counts = df.groupBy(code.alias("code")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.select(
        "code", "n", ratio(F.col("n"), F.lit(total)).alias("share"), F.coalesce(F.col("code").isin(list(allowed)), F.lit(False)).alias("known")
    )


def control_coverage(dim: DataFrame, region: str, closed: Column, alive: Column) -> DataFrame:
    """Share of closed entities whose region still holds an alive one."""
    regions = dim.groupBy(region).agg(count_where(alive).alias("alive"), count_where(closed).alias("closed"))
    covered = F.when(F.col(region).isNotNull() & (F.col("alive") > 0), F.col("closed")).otherwise(0)
    return regions.agg(F.sum("closed").alias("events"), ratio(F.sum(covered), F.sum("closed")).alias("coverage"))


def life_checks(dim: DataFrame, birth: str, death: str, first: str) -> DataFrame:
    """Deaths before birth, share without a death (and whether it is in (0, 1)), deaths before entry."""
    censored = share_where(F.col(death).isNull())
    return dim.agg(
        count_where(F.col(death) < F.col(birth)).alias("death_before_birth"), censored.alias("censored_ratio"),
        ((censored > 0) & (censored < 1)).alias("censored_ratio_ok"),
        count_where(F.col(death) < F.col(first)).alias("event_before_window"),
    )


def fact_drift(stored: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Facts that were added, removed or changed (two small key/value tables)."""
    a = stored.select(key, F.col(value).cast("string").alias("stored"))
    b = current.select(key, F.col(value).cast("string").alias("current"))
    return a.join(b, key, "full_outer").filter(~F.col("stored").eqNullSafe(F.col("current")))


BUCKETS = 4096


def _bucket_sums(df: DataFrame, keys: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Rows, two checksums of keys and numbers, and values per number, by bucket of the key."""
    row = [F.col(k) for k in keys] + [F.col(c).cast("double") for c in numbers]
    marks = [F.sum(F.xxhash64(*row, F.lit(s)).cast("decimal(38,0)")).alias(f"s{s}") for s in (1, 2)]
    return df.groupBy(_bucket(keys).alias("bucket")).agg(F.count("*").alias("n"), *marks, *[F.count(c).alias(f"v_{c}") for c in numbers])


def _bucket(keys: Sequence[str]) -> Column:
    """A bucket by key; none for a row without a whole key, which matches nothing."""
    whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    return F.when(whole, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], numbers: Sequence[str],
              tolerance: float = 1e-9, relative: bool = False, unique_keys: bool = True) -> DataFrame:
    """Row counts, matched rows, null mismatches and largest difference per number, with a verdict.

    Checksums of ``BUCKETS`` key ranges are compared first, and only rows of unequal buckets are joined; so equal tables
    shuffle a row per bucket and task. That needs ``keys`` to name a row; with ``unique_keys=False`` all rows are joined.
    """
    keys, same = list(keys), None
    if unique_keys:
        a, b = _bucket_sums(left, keys, numbers), _bucket_sums(right, keys, numbers)
        equal = a.alias("a").join(b.alias("b"), F.col("a.bucket") == F.col("b.bucket")).where("a.n = b.n AND a.s1 = b.s1 AND a.s2 = b.s2")
        same = cut(equal.select("a.*").drop("s1", "s2"))  # at most BUCKETS rows
        names = F.broadcast(same.select("bucket"))
        left, right = (d.withColumn("bucket", _bucket(keys)).join(names, "bucket", "left_anti") for d in (left, right))
    a = left.select(*keys, F.lit(1).alias("_l"), *[F.col(c).cast("double").alias(f"l_{c}") for c in numbers])
    b = right.select(*keys, F.lit(1).alias("_r"), *[F.col(c).cast("double").alias(f"r_{c}") for c in numbers])
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    counts = ["rows_left", "rows_right", "rows_both"]
    aggs = [count_where(F.col("_l").isNotNull()).alias("rows_left"), count_where(F.col("_r").isNotNull()).alias("rows_right"),
            count_where(both).alias("rows_both")]
    for c in numbers:
        gap = F.abs(F.col(f"l_{c}") - F.col(f"r_{c}"))
        if relative:
            gap = gap / F.greatest(F.abs(F.col(f"l_{c}")), F.abs(F.col(f"r_{c}")), F.lit(1e-300))
        aggs += [
            count_where(both & (F.col(f"l_{c}").isNull() != F.col(f"r_{c}").isNull())).alias(f"nulls_{c}"),
            F.max(gap).alias(f"gap_{c}"),
        ]
    wide = a.join(b, keys, "full_outer").agg(*aggs)
    if same is not None:
        settled = same.agg(*[F.coalesce(F.sum("n"), F.lit(0)).alias(c) for c in counts], *[F.lit(0).cast("long").alias(f"nulls_{c}") for c in numbers],
                           *[F.max(F.when(F.col(f"v_{c}") > 0, 0.0)).alias(f"gap_{c}") for c in numbers])
        wide = wide.unionByName(settled).agg(
            *[F.sum(c).alias(c) for c in counts], *[F.sum(f"nulls_{c}").alias(f"nulls_{c}") for c in numbers], *[F.max(f"gap_{c}").alias(f"gap_{c}") for c in numbers])
    whole = (F.col("rows_left") == F.col("rows_both")) & (F.col("rows_right") == F.col("rows_both"))
    lines = F.array(*[
        F.struct(
            F.lit(c).alias("field"), *counts, F.col(f"nulls_{c}").alias("null_mismatch"),
            F.col(f"gap_{c}").alias("max_diff"),
            (whole & (F.col(f"nulls_{c}") == 0) & (F.coalesce(F.col(f"gap_{c}"), F.lit(0.0)) <= tolerance)).alias("ok"),
        )
        for c in numbers
    ])
    return wide.select(F.inline(lines))
