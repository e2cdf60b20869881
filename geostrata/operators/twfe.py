"""Two-way fixed effects, event studies and the tables around them.

``exact`` removes entity and period effects fully on unbalanced panels. Entity effects are means, so only the period
effects are unknown; their normal equations are solved by conjugate gradients without ever forming the matrix. A step is
one aggregation over the presence patterns of entities: a number per pattern, then a sum per period. All columns move
in the same passes. ``one_pass`` is the balanced-panel shortcut x - mean_entity - mean_period + mean.

A regressor that the effects or earlier regressors explain is dropped: its coefficient and error are null and its name
stands in the fit's ``dropped``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.functions.columns import clipped
from geostrata.functions.tails import two_sided
from geostrata.operators.linear import Fit, cross_moments, linear_index
from geostrata.operators.skew import hot_key_join
from geostrata.session import cut

PRE, POST = 3, 4
MAX_PERIODS = 2000
COLLINEAR = 1e-10


def demean(
    df: DataFrame, columns: Sequence[str], entity: str, time: str, method: str = "one_pass"
) -> DataFrame:
    """Replace ``columns`` by their two-way within transform (rows with a null are left out)."""
    return _demeaned(df, columns, entity, time, method)[0]


def _demeaned(df, columns, entity, time, method):
    columns = list(columns)
    data = df.dropna(subset=[entity, time, *columns])
    if method == "exact":
        return _exact(data, columns, entity, time)
    if method != "one_pass":
        raise ValueError(f"unknown demeaning method: {method}")
    per_entity = cut(
        data.groupBy(entity).agg(F.count("*").alias("_n"), *[F.avg(c).alias(f"_e_{c}") for c in columns])
    )
    joined = hot_key_join(data, per_entity, [entity], "_n").drop("_n")
    stats = data.groupBy(time).agg(F.count("*").alias("_n"), *[F.avg(c).alias(f"_t_{c}") for c in columns])
    grand = data.agg(*[F.avg(c).alias(c) for c in columns]).first()
    out = hot_key_join(joined, stats, [time], "_n").drop("_n")
    new = {
        c: F.col(c) - F.col(f"_e_{c}") - F.col(f"_t_{c}") + F.lit(grand[c]) for c in columns
    }
    return out.withColumns(new).drop(*[f"_{s}_{c}" for s in "et" for c in columns]), {}


def _exact(data, columns, entity, time):
    """The within transform and ``{"rounds", "patterns"}`` of the solution.

    One row per entity holds its means and, by period, its rows and their sums; all that follows reads these rows, and the
    data are joined to them once.
    """
    spark = data.sparkSession
    per_time = data.groupBy(time).agg(F.count("*").cast("double").alias("n")).limit(MAX_PERIODS + 1).collect()
    if len(per_time) > MAX_PERIODS:
        raise ValueError("too many periods for two-way effects")
    held = {r[time]: r["n"] for r in per_time}
    periods = sorted(held)
    at = {t: i for i, t in enumerate(periods)}
    time_type = data.schema[time].dataType.simpleString()
    named = F.broadcast(spark.createDataFrame(list(at.items()), f"`{time}` {time_type}, _i int"))  # at most MAX_PERIODS rows
    sums = [F.sum(F.col(c).cast("double")).alias(f"s{j}") for j, c in enumerate(columns)]
    cells = data.groupBy(entity, time).agg(F.count("*").cast("double").alias("c"), *sums)
    # at most one entry a period
    by_period = F.array_sort(F.collect_list(F.struct(F.col("_i").alias("t"), "c", *[f"s{j}" for j in range(len(columns))])))
    per_entity = cut(
        cells.join(named, time).groupBy(entity)
        .agg(by_period.alias("p"), F.sum("c").alias("_n"), *[(F.sum(f"s{j}") / F.sum("c")).alias(f"_e_{c}") for j, c in enumerate(columns)])
    )
    # entities with the same presence pattern are one row
    presence = F.transform("p", lambda x: F.struct(x["t"].alias("t"), x["c"].alias("c")))
    patterns = cut(per_entity.groupBy(presence.alias("p")).agg(F.sum(F.lit(1.0) / F.col("_n")).alias("w")))
    left = per_entity.select(F.explode("p").alias("x"), *[F.col(f"_e_{c}").alias(f"e{j}") for j, c in enumerate(columns)])
    left = left.groupBy("x.t").agg(*[F.sum(F.col(f"x.s{j}") - F.col("x.c") * F.col(f"e{j}")) for j in range(len(columns))]).collect()
    target = np.zeros((len(periods), len(columns)))
    for r in left:
        target[r[0]] = r[1:]
    own = np.array([held[t] for t in periods])

    def with_values(rows: DataFrame, v: np.ndarray) -> DataFrame:
        """Rows with period values, an array for each column, as ``v``."""
        one = spark.createDataFrame([(1, v.T.tolist())], "one int, v array<array<double>>")
        return rows.withColumn("one", F.lit(1)).join(F.broadcast(one), "one").drop("one")

    def total(j: int):
        return F.aggregate("p", F.lit(0.0), lambda s, x: s + x["c"] * F.col("v")[j][x["t"]])

    def applied(v: np.ndarray) -> np.ndarray:
        """Period sums of what is left of period effects ``v`` when entity means are taken off."""
        means = [total(j) * F.col("w") for j in range(v.shape[1])]
        rows = with_values(patterns, v).select("p", F.array(*means).alias("m"))
        parts = rows.select(F.explode("p").alias("x"), "m").groupBy("x.t").agg(*[F.sum(F.col("x.c") * F.col("m")[j]).alias(f"s{j}") for j in range(v.shape[1])])
        out = own[:, None] * v
        for r in parts.collect():
            out[r[0]] -= r[1:]
        return out

    effects, rounds = conjugate_gradients(applied, target, own, 4 * len(periods) + 50)
    table = spark.createDataFrame(
        [(t, *map(float, effects[i])) for t, i in at.items()],
        f"`{time}` {time_type}, " + ", ".join(f"`_f_{c}` double" for c in columns),
    )
    means = with_values(per_entity, effects).select(
        entity, "_n", *[f"_e_{c}" for c in columns], *[(total(j) / F.col("_n")).alias(f"_g_{c}") for j, c in enumerate(columns)])
    out = hot_key_join(data.join(F.broadcast(table), time), means, [entity], "_n").drop("_n")  # at most MAX_PERIODS rows
    new = {
        c: F.col(c) - F.col(f"_e_{c}") - F.col(f"_f_{c}") + F.col(f"_g_{c}") for c in columns
    }
    return out.withColumns(new).drop(*[f"_{s}_{c}" for s in "efg" for c in columns]), {"rounds": rounds, "patterns": patterns.count()}


def conjugate_gradients(applied, target: np.ndarray, diagonal: np.ndarray, most: int, tolerance: float = 1e-12) -> tuple[np.ndarray, int]:
    """Solve ``applied(x) = target`` for a positive semidefinite map, column by column in common passes.

    ``diagonal`` scales the residual. Returns the solution and the number of passes. A column that has converged
    stands still; ``ValueError`` when one has not after ``most`` passes.
    """
    x, r = np.zeros_like(target), target.copy()
    scale = np.maximum(np.abs(target).max(0, initial=0.0), np.finfo(float).tiny)
    z = r / diagonal[:, None]
    d, rz, passes = z.copy(), (r * z).sum(0), 0
    while (active := np.abs(r).max(0, initial=0.0) > tolerance * scale).any():
        if passes >= most:
            if (np.abs(r).max(0) > 1e-8 * scale).any():
                raise ValueError("period effects did not converge")
            break
        passes += 1
        ad = applied(d)
        curve = (d * ad).sum(0)
        go = active & (curve > 0)
        if not go.any():
            break
        step = np.where(go, rz / np.where(go, curve, 1.0), 0.0)
        x, r = x + step * d, r - step * ad
        z = r / diagonal[:, None]
        now = (r * z).sum(0)
        d = np.where(go, z + np.where(rz > 0, now / np.where(rz > 0, rz, 1.0), 0.0) * d, 0.0)
        rz = now
    return x, passes


def kept_terms(moments: np.ndarray, raw: Sequence[float], tolerance: float = COLLINEAR) -> list[int]:
    """Places of regressors that the earlier kept ones leave more than ``tolerance`` of their raw sum of squares."""
    kept: list[int] = []
    for j, size in enumerate(raw):
        rest = moments[j, j]
        if kept:
            rest = rest - moments[j, kept] @ np.linalg.solve(moments[np.ix_(kept, kept)], moments[kept, j])
        if rest > tolerance * size:
            kept.append(j)
    return kept


def within_ols(
    df: DataFrame, y: str, xs: Sequence[str], entity: str, time: str, method: str = "exact"
) -> Fit:
    """Two-way within regression with standard errors clustered by entity.

    Regressors that the effects or earlier regressors explain have no coefficient (``extra["dropped"]``). ``extra``
    also tells the passes and presence patterns of the exact form.
    """
    xs = list(xs)
    data = df.select(entity, time, y, *xs)
    within, solved = _demeaned(data, [y, *xs], entity, time, method)
    dm = cut(within)
    m = cross_moments(dm, [*xs, y])
    raw = data.dropna().agg(*[F.coalesce(F.sum(F.col(x) * F.col(x)), F.lit(0.0)).cast("double") for x in xs]).first()
    kept = kept_terms(m[:-1, :-1], raw)
    names = [xs[i] for i in kept]
    inv = np.linalg.inv(m[np.ix_(kept, kept)]) if kept else np.zeros((0, 0))
    beta = inv @ m[kept, -1]
    resid = F.col(y) - linear_index(names, beta)
    meat = np.zeros((0, 0))
    if kept:
        scores = dm.withColumn("_r", resid).groupBy(entity).agg(*[F.sum(F.col(x) * F.col("_r")).alias(x) for x in names])
        meat = cross_moments(scores, names)
    row = dm.withColumn("_r", resid).agg(
        F.count("*").alias("n"), F.sum(F.col("_r") * F.col("_r")).alias("rss"), F.var_pop(y).alias("v")
    ).first()
    size = dm.agg(F.countDistinct(entity).alias("g"), F.countDistinct(time).alias("t")).first()
    n, k, g = row["n"], len(kept), size["g"]
    adjust = (g / max(g - 1, 1)) * ((n - 1) / max(n - k, 1))
    cov = inv @ meat @ inv * adjust
    tss = (row["v"] or 0.0) * n
    coefs, errors = np.full(len(xs), np.nan), np.full(len(xs), np.nan)
    coefs[kept], errors[kept] = beta, np.sqrt(np.maximum(np.diag(cov), 0))
    return Fit(
        xs, coefs, errors, n, max(g - 1, 1),
        {"n_entities": g, "n_times": size["t"], "r2_within": 1 - row["rss"] / tss if tss else None,
         "dropped": [x for x in xs if x not in names], **solved},
    )


def did_sample(panel: DataFrame, rate: str, time: str, first: str = "first_event_year",
               pre: int = PRE, post: int = POST, clip: float = 0.5) -> DataFrame:
    """Outcome ``y`` clipped; treated rows only inside the event window, controls in every year."""
    tau = F.col(time) - F.col(first)
    inside = (F.col(first) <= 0) | tau.between(-pre, post)
    return (
        panel.filter(F.col(rate).isNotNull()).withColumn("y", clipped(rate, -clip, clip))
        .withColumn("tau", F.when(F.col(first) > 0, tau)).filter(inside)
    )


def twfe(panel: DataFrame, rate: str, entity: str, time: str, strength: str = "strength_t0",
         method: str = "exact", pre: int = PRE, post: int = POST) -> Fit:
    """Growth on [post x strength, post] with entity and period effects."""
    d = did_sample(panel, rate, time, pre=pre, post=post).withColumns({
        "post": F.col("post").cast("double"),
        "post_x_strength": F.col("post").cast("double") * F.col(strength),
    })
    return within_ols(d, "y", ["post_x_strength", "post"], entity, time, method)


def event_study(panel: DataFrame, rate: str, entity: str, time: str, method: str = "one_pass",
                pre: int = PRE, post: int = POST, base: int = -1) -> tuple[list[tuple], dict]:
    """Effects by event time with ``base`` as the omitted period: rows (tau, effect, se, p)."""
    taus = [r for r in range(-pre, post + 1) if r != base]
    names = {r: f"tau_{'m' if r < 0 else 'p'}{abs(r)}" for r in taus}
    d = did_sample(panel, rate, time, pre=pre, post=post).withColumns({
        names[r]: F.coalesce((F.col("tau") == r).cast("double"), F.lit(0.0)) for r in taus
    })
    fit = within_ols(d, "y", list(names.values()), entity, time, method)
    rows, worst = [], 0.0
    for r in range(-pre, post + 1):
        if r == base:
            rows.append((r, 0.0, 0.0, 1.0))
            continue
        b, s = fit.coef(names[r]), fit.std_err(names[r])
        t = b / s if s else None
        rows.append((r, b, s, two_sided(t, fit.dof)))
        if r < 0 and t is not None:
            worst = max(worst, abs(t))
    return rows, {"pre_trend_max_abs_t": worst, "n_obs": fit.n, "n_entities": fit.extra["n_entities"]}


def ring_sensitivity(panel: DataFrame, rate: str, entity: str, time: str,
                     strengths: dict[str, str], method: str = "exact") -> tuple[list[dict], dict]:
    """Refit under several strength definitions and compare slopes on a common scale; dropped terms are null."""
    rows = []
    for name, column in strengths.items():
        fit = twfe(panel, rate, entity, time, column, method)
        mean = panel.filter(F.col("first_event_year") > 0).agg(F.avg(column)).first()[0]
        b, p = fit.coef("post_x_strength"), fit.coef("post")
        rows.append({
            "variant": name, "coef": b, "se": fit.std_err("post_x_strength"), "post_coef": p,
            "strength_mean_treated": mean, "slope_per_relative_exposure": None if None in (b, mean) else b * mean,
            "effect_at_treated_mean": None if None in (b, p, mean) else p + b * mean, "n_obs": fit.n,
        })
    slopes = [r["slope_per_relative_exposure"] for r in rows if r["slope_per_relative_exposure"] is not None]
    effects = [r["effect_at_treated_mean"] for r in rows if r["effect_at_treated_mean"] is not None]
    spread = {
        "slope_spread_pct": (max(slopes) - min(slopes)) / max(slopes) * 100 if slopes and max(slopes) else None,
        "effect_at_mean_spread_pp": (max(effects) - min(effects)) * 100 if effects else None,
    }
    return rows, spread


def marginal_effect(coefs: DataFrame, grid_end: float = 5.0, step: float = 0.125) -> DataFrame:
    """Effect at strength s with its intervals, for each row (b0, se0, b1, se1) of ``coefs``."""
    points = int(round(grid_end / step))
    s = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: i * F.lit(step))).alias("s")
    c = coefs.select("*", s)
    effect = F.col("b0") + F.col("b1") * F.col("s")
    se = F.sqrt(F.col("se0") * F.col("se0") + F.col("s") * F.col("s") * F.col("se1") * F.col("se1"))
    worst = F.abs("se0") + F.abs("s") * F.abs("se1")
    keep = [x for x in coefs.columns if x not in ("b0", "b1", "se0", "se1")]
    return c.select(
        *keep, "s", effect.alias("effect"), se.alias("se"),
        (effect - 1.96 * se).alias("ci_lo"), (effect + 1.96 * se).alias("ci_hi"),
        (effect - 1.96 * worst).alias("worst_lo"), (effect + 1.96 * worst).alias("worst_hi"),
        F.try_divide(-F.col("b0"), F.col("b1")).alias("zero_crossing"),
    )
