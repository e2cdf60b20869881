"""Spatial regressions from scalar products; no n x n matrix is ever formed."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.functions.columns import correlation
from geostrata.functions.tails import chi2_1_upper
from geostrata.operators.linear import Fit, cross_moments, linear_index, ols, with_const
from geostrata.operators.weights import spatial_lag, weight_moments
from geostrata.session import cut


def _prepared(nodes: DataFrame, y: str, xs: Sequence[str], node: str) -> DataFrame:
    cols = [F.col(node).alias("id"), F.col(y).cast("double").alias("y")]
    return nodes.select(*cols, *[F.col(x).cast("double").alias(x) for x in xs]).dropna()


def slx(nodes: DataFrame, weights: DataFrame, y: str, xs: Sequence[str], node: str = "id") -> Fit:
    """Least squares on the regressors and their spatial lags."""
    d = _prepared(nodes, y, xs, node)
    lagged = spatial_lag(d, weights, {f"W_{x}": x for x in xs})
    return ols(lagged, "y", [*xs, *[f"W_{x}" for x in xs]])


def lm_tests(nodes: DataFrame, weights: DataFrame, y: str, xs: Sequence[str], node: str = "id",
             form: str = "anselin") -> dict:
    """Lagrange-multiplier tests for a spatial lag and a spatial error, plain and robust.

    ``anselin`` is the textbook form with the trace of W'W + WW; ``reference`` is the simplified
    one that leaves the trace out.
    """
    d = _prepared(nodes, y, xs, node)
    fit = ols(d, "y", xs)
    e = F.col("y") - linear_index(fit.terms, fit.beta)
    work = with_const(d.withColumn("e", e))
    fitted = work.withColumn("xb", F.col("y") - F.col("e"))
    lagged = cut(spatial_lag(fitted, weights, {"wy": "y", "we": "e", "wxb": "xb"}))
    means = lagged.agg(F.avg("wy").alias("wy"), F.avg("wxb").alias("wxb")).first()
    # residuals do not change with a constant taken off, and small differences stay exact
    lagged = lagged.withColumns({c: F.col(c) - F.lit(means[c]) for c in ("wy", "wxb")})
    terms = fit.terms
    m = cross_moments(lagged, [*terms, "e", "wy", "we", "wxb"])
    k = len(terms)
    ee, e_wy, e_we = m[k, k], m[k, k + 1], m[k, k + 2]
    we_we = m[k + 2, k + 2]
    x_wy, x_wxb = m[:k, k + 1], m[:k, k + 3]
    inv = fit.extra["xtx_inv"]
    n = fit.n
    if form == "reference":
        s2 = fit.extra["sigma2"]
        dof = max(n - k, 1)
        t_lag = (m[k + 1, k + 1] - x_wy @ inv @ x_wy) / s2
        t_err = we_we / s2
        lag = e_wy ** 2 / (t_lag * s2)
        err = e_we ** 2 / (t_err * s2 * dof)
        gap = (e_wy - e_we) / (ee + 1e-12)
        both = 1 / max(t_lag, 1e-12) + 1 / max(t_err, 1e-12)
        rlag = rerr = max(gap ** 2 / both, 0.0)
    elif form == "anselin":
        s2 = ee / n
        moments = weight_moments(weights).first()
        trace = moments["s1"]  # tr(W'W + WW) equals half the sum of (w_ij + w_ji)^2
        nj = (m[k + 3, k + 3] - x_wxb @ inv @ x_wxb) / s2 + trace
        d_lag, d_err = e_wy / s2, e_we / s2
        lag, err = d_lag ** 2 / nj, d_err ** 2 / trace
        rlag = (d_lag - d_err) ** 2 / (nj - trace)
        rerr = (d_err - trace / nj * d_lag) ** 2 / (trace * (1 - trace / nj))
    else:
        raise ValueError(f"unknown form: {form}")
    out = {}
    for name, stat in (("lm_lag", lag), ("lm_error", err), ("robust_lag", rlag), ("robust_error", rerr)):
        out[name], out[f"{name}_p"] = float(stat), chi2_1_upper(float(stat))
    return out


def choose_model(tests: dict, level: float = 0.05) -> str:
    """Which spatial model the test p-values point to."""
    lag, err = tests["robust_lag_p"], tests["robust_error_p"]
    if lag < level and lag < err:
        return "lag"
    if err < level and err < lag:
        return "error"
    if tests["lm_lag_p"] < level and tests["lm_error_p"] < level:
        return "sdm"
    return "ols"


def sar_2sls(nodes: DataFrame, weights: DataFrame, y: str, xs: Sequence[str], node: str = "id",
             durbin: bool = False) -> Fit:
    """Spatial lag model by two-stage least squares; instruments are WX (and WWX with ``durbin``)."""
    xs = list(xs)
    d = _prepared(nodes, y, xs, node)
    first = spatial_lag(d, weights, {"Wy": "y", **{f"W_{x}": x for x in xs}})
    wx = [f"W_{x}" for x in xs]
    extra = wx
    if durbin:
        first = spatial_lag(cut(first), weights, {f"WW_{x}": f"W_{x}" for x in xs})
        extra = [f"WW_{x}" for x in xs]
    data = cut(with_const(first))
    terms = ["const", *xs, *(wx if durbin else []), "rho"]
    z = ["const", *xs, *(wx if durbin else []), "Wy"]
    h = ["const", *xs, *(wx if durbin else []), *extra]
    names = list(dict.fromkeys([*h, "Wy", "y"]))
    m = cross_moments(data, names)
    at = {c: i for i, c in enumerate(names)}
    pick = lambda a, b: m[np.ix_([at[c] for c in a], [at[c] for c in b])]
    hh, hz, hy = pick(h, h), pick(h, z), pick(h, ["y"])[:, 0]
    proj = hz.T @ np.linalg.pinv(hh)
    inv = np.linalg.pinv(proj @ hz)
    beta = inv @ proj @ hy
    pred = linear_index(z, beta)
    row = data.agg(
        F.count("*").alias("n"), F.sum(F.pow(F.col("y") - pred, F.lit(2))).alias("rss"),
        correlation("y", pred).alias("r"),
    ).first()
    n = row["n"]
    se = np.sqrt(np.maximum(np.diag(inv) * row["rss"] / n, 0))
    return Fit(terms, beta, se, n, None, {"rho": float(beta[-1]), "pseudo_r2": (row["r"] or 0.0) ** 2})


def sem_gmm(nodes: DataFrame, weights: DataFrame, y: str, xs: Sequence[str], node: str = "id") -> Fit:
    """Spatial error model: moment estimate of lambda, then least squares on filtered data."""
    xs = list(xs)
    d = _prepared(nodes, y, xs, node)
    start = ols(d, "y", xs)
    u = d.withColumn("u", F.col("y") - linear_index(start.terms, start.beta))
    one = cut(spatial_lag(u, weights, {"wu": "u"}))
    two = spatial_lag(one, weights, {"wwu": "wu"})
    m = cross_moments(two, ["u", "wu", "wwu"])
    n = start.n
    trace = weights.agg(F.sum(F.col("w") * F.col("w"))).first()[0] / n  # tr(W'W) / n
    uu, uw, uww, ww, w_ww, wwww = m[0, 0], m[0, 1], m[0, 2], m[1, 1], m[1, 2], m[2, 2]
    big = np.array([[2 * uw, -ww, n], [2 * w_ww, -wwww, n * trace], [uww + ww, -w_ww, 0.0]]) / n
    small = np.array([uu, ww, uw]) / n

    def loss(lam):
        s2 = _best_scale(big, small, lam)
        r = small - big @ np.array([lam, lam * lam, s2])
        return float(r @ r)

    grid = np.linspace(-0.99, 0.99, 199)
    best = min(grid, key=loss)
    lo, hi = best - 0.01, best + 0.01
    for _ in range(80):  # golden-section refinement of a smooth one-dimensional loss
        a, b = hi - (hi - lo) * 0.6180339887498949, lo + (hi - lo) * 0.6180339887498949
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    lam = (lo + hi) / 2

    cols = ["y", *xs]
    lag = spatial_lag(with_const(d), weights, {f"_l_{c}": c for c in [*cols, "const"]})
    filtered = lag.select(
        "id", *[(F.col(c) - lam * F.col(f"_l_{c}")).alias(c) for c in cols],
        (F.lit(1.0) - lam * F.col("_l_const")).alias("intercept"),
    )
    fit = ols(filtered, "y", ["intercept", *xs], const=False)
    return Fit(
        ["const", *xs, "lambda"], np.append(fit.beta, lam), np.append(fit.se, 0.0), n, None,
        {"lambda": float(lam), "sigma2": fit.extra["sigma2"]},
    )


def _best_scale(big, small, lam):
    rest = small - big[:, 0] * lam - big[:, 1] * lam * lam
    col = big[:, 2]
    return float(col @ rest / (col @ col))


def split_effects(models: dict[str, Fit], term: str) -> list[dict]:
    """First-order direct, spillover and total effect of ``term`` for each fitted model."""
    out = []
    for name, fit in models.items():
        b = fit.coef(term)
        if name == "sem":
            direct, spill = b, 0.0
        else:
            rho = fit.extra["rho"]
            if abs(rho) >= 0.99:
                continue
            wb = fit.coef(f"W_{term}") if name == "sdm" else 0.0
            direct, spill = b / (1 - rho), (b + wb) * rho / (1 - rho) ** 2
        total = direct + spill
        share = spill / total if abs(total) > 1e-12 else None
        out.append({"model": name, "direct": direct, "spillover": spill, "total": total, "share": share})
    return out
