"""Least squares from distributed moments: one aggregation for X'X and X'y, algebra on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.functions.tails import two_sided

COEFFICIENTS = "term string, coef double, std_err double, t double, p double"


@dataclass
class Fit:
    """Coefficients of a fitted model; a few numbers per term."""

    terms: list[str]
    beta: np.ndarray
    se: np.ndarray
    n: int
    dof: float | None
    extra: dict = field(default_factory=dict)

    def rows(self):
        out = []
        for term in self.terms:
            b, s = self.coef(term), self.std_err(term)
            t = b / s if s else None
            out.append((term, b, s, t, two_sided(t, self.dof)))
        return out

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows(), COEFFICIENTS)

    def coef(self, term: str) -> float | None:
        """Null for a term that was dropped."""
        b = float(self.beta[self.terms.index(term)])
        return None if math.isnan(b) else b

    def std_err(self, term: str) -> float | None:
        s = float(self.se[self.terms.index(term)])
        return None if math.isnan(s) else s


def cross_moments(df: DataFrame, columns: Sequence[str | Column]) -> np.ndarray:
    """All pairwise sums of products, in one aggregation."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    k = len(cols)
    aggs = [
        F.coalesce(F.sum(cols[i] * cols[j]), F.lit(0.0)).alias(f"m{i}_{j}")
        for i in range(k) for j in range(i, k)
    ]
    row = df.agg(*aggs).first()
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"m{i}_{j}"]
    return out


def linear_index(terms: Sequence[str], beta: Sequence[float]) -> Column:
    """sum of coefficient times column; the term ``const`` stands for 1."""
    out = F.lit(0.0)
    for t, b in zip(terms, beta):
        out = out + (F.lit(float(b)) if t == "const" else F.lit(float(b)) * F.col(t))
    return out


def with_const(df: DataFrame) -> DataFrame:
    return df if "const" in df.columns else df.withColumn("const", F.lit(1.0))


def ols(df: DataFrame, y: str, xs: Sequence[str], const: bool = True) -> Fit:
    """Classic least squares with R2, log-likelihood and AIC. Rows with a null are left out."""
    terms = (["const"] if const else []) + list(xs)
    data = df.select(F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(x) for x in xs])
    data = with_const(data.dropna())
    m = cross_moments(data, terms + ["_y"])
    xtx, xty = m[:-1, :-1], m[:-1, -1]
    inv = np.linalg.pinv(xtx)
    beta = inv @ xty
    resid = F.col("_y") - linear_index(terms, beta)
    row = data.agg(F.count("*").alias("n"), F.sum(resid * resid).alias("rss"), F.var_pop("_y").alias("v")).first()
    n, k = row["n"], len(terms)
    sigma2 = row["rss"] / max(n - k, 1)
    se = np.sqrt(np.maximum(np.diag(inv) * sigma2, 0))
    tss = row["v"] * n
    loglik = -n / 2 * (math.log(2 * math.pi * row["rss"] / n) + 1) if row["rss"] > 0 else math.inf
    return Fit(
        terms, beta, se, n, max(n - k, 1),
        {"r2": 1 - row["rss"] / tss if tss > 0 else None, "sigma2": sigma2, "rss": row["rss"],
         "loglik": loglik, "aic": 2 * k - 2 * loglik, "xtx_inv": inv},
    )
