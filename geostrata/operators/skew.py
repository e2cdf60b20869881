"""Joins that a few very frequent keys cannot hold up, in one plan for tables of every size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 1000
SALTS = 64


def spread_join(
    big: DataFrame, other: DataFrame, keys: Sequence[str], sizes: DataFrame, size: str, how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join ``big`` to ``other`` (inner or left), where ``sizes`` has one row per key with its rows in ``big``.

    The ``MAX_HOT_KEYS`` most frequent keys are named by a broadcast, so every key above 1/1000 of all rows is among
    them. Their rows are dealt over ``salts`` tasks by a hash of the row, and the matching rows of the other side are
    repeated in each. Rows of ``big`` without a key match nothing and are dealt the same way.
    """
    keys = list(keys)
    top = sizes.orderBy(F.col(size).desc(), *keys).limit(MAX_HOT_KEYS).select(*keys, F.lit(True).alias("_hot"))
    names = F.broadcast(top)  # at most MAX_HOT_KEYS rows
    loose = reduce(Column.__or__, [F.col(k).isNull() for k in keys], F.col("_hot"))
    deal = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)).cast("int")
    left = big.join(names, keys, "left").withColumn("_salt", F.when(loose, deal).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = other.join(names, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def hot_key_join(big: DataFrame, unique: DataFrame, keys: Sequence[str], size: str, how: str = "inner") -> DataFrame:
    """``spread_join`` to one-row-per-key data that holds the key's rows in ``big`` itself, as ``size``."""
    return spread_join(big, unique, keys, unique, size, how)
