"""Profiles that add up: one row per source and field, stored once and merged without reading the source again.

Counts, extremes and moments are exact. Quantiles come from KLL sketches of ``k`` (rank error about 1.33 % at the
default 200, less as 1 / k), distinct counts from HLL sketches of ``2**lg_k`` registers (relative standard error
1.04 / sqrt(registers), 1.6 % at 12; exact while they hold few values).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions.columns import numeric_columns

KLL_K, HLL_LG_K = 200, 12
PROFILE = ("source string, field string, rows long, non_null long, min double, max double, total double, squares double, "
           "kll binary, hll binary")


def profile_sources(df: DataFrame, source: str, columns: Sequence[str] | None = None, kll_k: int = KLL_K, lg_k: int = HLL_LG_K) -> DataFrame:
    """One row per value of ``source`` and column, in one pass. Columns that are not numbers have counts and an HLL sketch.

    NaN counts as null, as in the other profiles. Partial sketches are merged before the shuffle, so a source that holds most
    rows is no hot key.
    """
    cols = list(columns or [c for c in df.columns if c != source])
    numbers = set(numeric_columns(df))
    aggs, lines = [F.count("*").alias("_rows")], []
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`")
        if c in numbers:
            v = F.nanvl(v.cast("double"), F.lit(None).cast("double"))
            aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.sum(v).alias(f"s{i}"), F.sum(v * v).alias(f"q{i}"),
                     F.kll_sketch_agg_double(v, F.lit(kll_k)).alias(f"k{i}"), F.hll_sketch_agg(v.cast("string"), F.lit(lg_k)).alias(f"h{i}")]
            parts = [F.col(f"{x}{i}") for x in ("lo", "hi", "s", "q", "k")]
        else:
            aggs += [F.hll_sketch_agg(v.cast("string"), F.lit(lg_k)).alias(f"h{i}")]
            parts = [F.lit(None).cast(t) for t in ("double", "double", "double", "double", "binary")]
        aggs.append(F.count(v).alias(f"n{i}"))
        names = ("min", "max", "total", "squares", "kll")
        lines.append(F.struct(F.lit(c).alias("field"), F.col("_rows").alias("rows"), F.col(f"n{i}").alias("non_null"),
                              *[p.alias(n) for p, n in zip(parts, names)], F.col(f"h{i}").alias("hll")))
    per = df.groupBy(F.col(source).cast("string").alias("source")).agg(*aggs)
    return per.select("source", F.inline(F.array(*lines)))


def merged(profiles: DataFrame) -> DataFrame:
    """One row per field over all sources."""
    return profiles.groupBy("field").agg(
        F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.kll_merge_agg_double("kll").alias("kll"), F.hll_union_agg("hll", F.lit(True)).alias("hll"))


def summary(profile: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Readable columns of merged profiles: counts, extremes, mean, spread, quantiles and distinct values."""
    n, some = F.col("non_null"), F.col("min").isNotNull()
    mean = F.when(some, F.col("total") / n)
    spread = F.when(some, F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / n - mean * mean)))
    at = [F.when(some, F.kll_sketch_get_quantile_double("kll", F.lit(float(p)))).alias(f"q{int(round(p * 100)):02d}") for p in quantiles]
    return profile.select("field", "rows", "non_null", (F.col("rows") - n).alias("null_count"), "min", "max", mean.alias("mean"), spread.alias("std"), *at,
                          F.hll_sketch_estimate("hll").alias("distinct"))


def update(spark: SparkSession, store: str, sources: Sequence[str], read: Callable[[list[str]], DataFrame], source: str) -> list[str]:
    """Add the sources that ``store`` doesn't hold yet; returns their names. Only these are read.

    ``read`` gets the new names and returns their rows with the name in the column ``source``. Names are those of files,
    not data.
    """
    try:
        held = {r[0] for r in spark.read.schema(PROFILE).parquet(store).select("source").distinct().collect()}
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        held = set()
    new = [s for s in sources if s not in held]
    if new:
        profile_sources(read(new), source).write.mode("append").parquet(store)
    return new


def stored(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(PROFILE).parquet(store)
