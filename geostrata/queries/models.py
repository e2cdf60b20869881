"""Estimators and the jobs built from them."""

from pyspark.sql import functions as F

from geostrata.functions.columns import EARTH_RADIUS_KM, HEX_EDGE_KM, hex_center
from geostrata.operators import hazard as H
from geostrata.operators import moran as M
from geostrata.operators import panel as N
from geostrata.operators import rings as G
from geostrata.operators import spatial_reg as S
from geostrata.operators import twfe as T
from geostrata.operators import weights as W
from geostrata.operators.linear import ols
from geostrata.plans import jobs as J
from geostrata.queries.panels import CELLS, DID, PERSON, TREATED, _treated, cross_section, did, did_inputs
from geostrata.queries.registry import L, R, plain, query, table, view
from geostrata.queries.spatial import _knn_sql
from geostrata.queries.sqltext import RING_W, clustered_ols, demean_steps, fisher_steps, hash_draw, kept_sample
from geostrata.session import cut


@query("group_demean", f"""
WITH p AS (SELECT *, value - AVG(value) OVER (PARTITION BY entity) - AVG(value) OVER (PARTITION BY year) + AVG(value) OVER () AS dm FROM fx_panel)
SELECT {L('entity')} AS entity, {L('year')} AS year, {R('dm', 3)} AS value FROM p""")
def group_demean(spark, sf):
    return plain(T.demean(view(spark, sf, "fx_panel"), ["value"], "entity", "year").select("entity", "year", "value"), 3)


@query("group_demean_exact", f"""WITH {demean_steps('fx_panel', ['value'])} SELECT {L('entity')} AS entity, {L('year')} AS year, {R('value', 3)} AS value FROM dx""")
def group_demean_exact(spark, sf):
    return plain(T.demean(view(spark, sf, "fx_panel"), ["value"], "entity", "year", "exact").select("entity", "year", "value"), 3)


_dm = lambda c: f"{c} - AVG({c}) OVER (PARTITION BY entity) - AVG({c}) OVER (PARTITION BY year) + AVG({c}) OVER ()"
SAMPLE = "sm AS (SELECT entity, year, LEAST(GREATEST(chg_rate, -0.5), 0.5) AS y, post * s AS x1, post * 1.0 AS x2, year - fe AS tau, fe FROM dp WHERE chg_rate IS NOT NULL AND (fe <= 0 OR year - fe BETWEEN -3 AND 4))"
_TERM = "CASE gj.i WHEN 0 THEN 'post_x_strength' ELSE 'post' END AS term"


def _one_pass(source, xs):
    return f"dx AS MATERIALIZED (SELECT entity, year, {', '.join(f'{_dm(c)} AS {c}' for c in ['y', *xs])} FROM {source})"


@query("twfe", f"""WITH {DID}, {SAMPLE}, {_one_pass('sm', ['x1', 'x2'])}, {clustered_ols('dx', 'y', ['x1', 'x2'], 'sm')}
SELECT {_TERM}, {R('coef')} AS coef, {R('std_err')} AS std_err, {R('coef / std_err', 4)} AS t FROM gj JOIN ce ON ce.i = gj.i""")
def twfe(spark, sf):
    fit = T.twfe(cut(did(spark, sf)), "chg_rate", "entity", "year", method="one_pass")
    return plain(fit.table(spark).select("term", "coef", "std_err", F.round("t", 4).alias("t")))


@query("twfe_exact", f"""WITH {DID}, {SAMPLE}, {demean_steps('sm', ['y', 'x1', 'x2'])}, {clustered_ols('dx', 'y', ['x1', 'x2'], 'sm')}
SELECT {_TERM}, {R('coef')} AS coef, {R('std_err')} AS std_err FROM gj JOIN ce ON ce.i = gj.i""")
def twfe_exact(spark, sf):
    fit = T.twfe(cut(did(spark, sf)), "chg_rate", "entity", "year", method="exact")
    return plain(fit.table(spark).select("term", "coef", "std_err"))


TAUS = (-3, -2, 0, 1, 2, 3, 4)


def _event_sql(steps):
    xs = [f"d{j}" for j in range(len(TAUS))]
    dummies = ", ".join(f"CASE WHEN fe > 0 AND tau = {t} THEN 1.0 ELSE 0.0 END AS {x}" for t, x in zip(TAUS, xs))
    case = "CASE gj.i " + " ".join(f"WHEN {j} THEN {t}" for j, t in enumerate(TAUS)) + " END"
    return f"""WITH {DID}, {SAMPLE}, ed AS (SELECT entity, year, y, {dummies} FROM sm), {steps(xs)}, {clustered_ols('dx', 'y', xs, 'ed')},
rt AS (SELECT {case} AS tau, coef, std_err FROM gj JOIN ce ON ce.i = gj.i UNION ALL SELECT -1, 0, 0)
SELECT {L('tau')} AS tau, {R('coef')} AS effect, {R('std_err')} AS se, (SELECT {R('MAX(ABS(coef / std_err))', 4)} FROM rt WHERE tau < -1) AS pre_trend_max_abs_t FROM rt"""


def _event_rows(spark, sf, method):
    rows, stats = T.event_study(cut(did(spark, sf)), "chg_rate", "entity", "year", method)
    out = spark.createDataFrame(rows, "tau long, effect double, se double, p double").drop("p")
    return plain(out.withColumn("pre_trend_max_abs_t", F.round(F.lit(stats["pre_trend_max_abs_t"]), 4)))


@query("event_study", _event_sql(lambda xs: _one_pass("ed", xs)))
def event_study(spark, sf):
    return _event_rows(spark, sf, "one_pass")


@query("event_study_exact", _event_sql(lambda xs: demean_steps("ed", ["y", *xs])))
def event_study_exact(spark, sf):
    return _event_rows(spark, sf, "exact")


def _variant_sql(name, weights):
    """Two-way effects under other ring weights, one row."""
    return f"""SELECT * FROM (WITH {DID.replace(RING_W, weights)}, {SAMPLE}, {demean_steps('sm', ['y', 'x1', 'x2'])}, {clustered_ols('dx', 'y', ['x1', 'x2'], 'sm')},
fin AS (SELECT (SELECT coef FROM gj WHERE i = 0) AS b, (SELECT std_err FROM ce WHERE i = 0) AS s, (SELECT coef FROM gj WHERE i = 1) AS p, (SELECT AVG(s) FROM dp WHERE fe > 0) AS m, (SELECT COUNT(*) FROM sm) AS n)
SELECT '{name}' AS variant, {R('b')} AS coef, {R('s')} AS se, {R('p')} AS post_coef, {R('m')} AS strength_mean_treated, {R('b * m')} AS slope_per_relative_exposure, {R('p + b * m')} AS effect_at_treated_mean, {L('n')} AS n_obs FROM fin)"""


_COARSE = "CASE WHEN d < 2 THEN 1.0 WHEN d < 5 THEN 0.6 WHEN d < 10 THEN {last} ELSE 0.0 END"


@query("ring_sensitivity", " UNION ALL ".join(_variant_sql(n, w) for n, w in (
    ("fine", RING_W), ("coarse", _COARSE.format(last=0.3)), ("linear", _COARSE.format(last=0.2)))))
def ring_sensitivity(spark, sf):
    panel, alive, _ = did_inputs(spark, sf)
    dim = view(spark, sf, "fx_dim")
    edges = (0, 1, 2, 3, 5, 10)
    events = dim.filter("acq_year IS NOT NULL AND lat IS NOT NULL").withColumnRenamed("acq_year", "event_year")
    counts = cut(G.event_counts(alive, events, edges))
    treat = G.first_exposure(counts, edges=edges)
    for name, rings in (("coarse", G.COARSE_REBINNED), ("linear", G.COARSE_LINEAR)):
        treat = treat.join(G.first_exposure(counts, rings, edges, strength=f"strength_{name}").drop("first_event_year"), "entity")
    d = cut(N.did_panel(panel, treat, alive, "entity", "year").withColumns({f"strength_{n}": F.coalesce(f"strength_{n}", F.lit(0.0)) for n in ("coarse", "linear")}))
    rows, _ = T.ring_sensitivity(d, "chg_rate", "entity", "year", {"fine": "strength_t0", "coarse": "strength_coarse", "linear": "strength_linear"})
    schema = "variant string, coef double, se double, post_coef double, strength_mean_treated double, slope_per_relative_exposure double, effect_at_treated_mean double, n_obs long"
    return plain(spark.createDataFrame([tuple(r.values()) for r in rows], schema))


@query("marginal_effect", f"""
WITH c AS (SELECT grp, AVG(risk) - 0.7 AS b0, STDDEV_SAMP(risk) / 10 AS se0, AVG(event) / 4 AS b1, STDDEV_SAMP(risk) / 40 AS se1 FROM fx_score GROUP BY grp),
s AS (SELECT UNNEST(RANGE(0, 41)) * 0.125 AS s)
SELECT grp, {R('s')} AS s, {R('b0 + b1 * s')} AS effect, {R('SQRT(se0 * se0 + s * s * se1 * se1)')} AS se, {R('b0 + b1 * s - 1.96 * SQRT(se0 * se0 + s * s * se1 * se1)')} AS ci_lo,
  {R('b0 + b1 * s + 1.96 * SQRT(se0 * se0 + s * s * se1 * se1)')} AS ci_hi, {R('b0 + b1 * s - 1.96 * (ABS(se0) + ABS(s) * ABS(se1))')} AS worst_lo,
  {R('b0 + b1 * s + 1.96 * (ABS(se0) + ABS(s) * ABS(se1))')} AS worst_hi, {R('-b0 / b1')} AS zero_crossing FROM c, s""")
def marginal_effect(spark, sf):
    c = view(spark, sf, "fx_score").groupBy("grp").agg(
        (F.avg("risk") - 0.7).alias("b0"), (F.stddev_samp("risk") / 10).alias("se0"), (F.avg("event") / 4).alias("b1"), (F.stddev_samp("risk") / 40).alias("se1"))
    return plain(T.marginal_effect(c))


OLS = "r AS (SELECT COUNT(*) AS n, REGR_SLOPE(y, x) AS b, REGR_INTERCEPT(y, x) AS a, REGR_R2(y, x) AS r2, REGR_SXX(y, x) AS sxx, REGR_SYY(y, x) AS syy, AVG(x) AS mx FROM d), e AS (SELECT *, (1 - r2) * syy / (n - 2) AS s2 FROM r)"


@query("ols", f"""
WITH d AS (SELECT o_totalprice / 1000 AS y, o_orderkey * 0.001 AS x FROM orders), {OLS}
SELECT 'const' AS term, {R('a', 5)} AS coef, {R('SQRT(s2 * (1.0 / n + mx * mx / sxx))', 5)} AS std_err, {R('r2', 5)} AS r2 FROM e
UNION ALL SELECT 'x', {R('b', 5)}, {R('SQRT(s2 / sxx)', 5)}, {R('r2', 5)} FROM e""")
def ols_query(spark, sf):
    d = table(spark, sf, "orders").select((F.col("o_totalprice") / 1000).alias("y"), (F.col("o_orderkey") * 0.001).alias("x"))
    fit = ols(d, "y", ["x"])
    return plain(fit.table(spark).select("term", "coef", "std_err", F.lit(fit.extra["r2"]).alias("r2")), 5)


def _nodes(spark, sf):
    d = view(spark, sf, "fx_dim").filter("lat is not null")
    return cut(d.select(F.col("entity").alias("id"), "lat", "lng", (F.col("last_year") - F.col("first_year") + F.col("lat")).alias("y"), (F.col("entity") % 7).cast("double").alias("x")))


SLX = f"""{_knn_sql('plane', 6)}, nd AS (SELECT entity, last_year - first_year + lat AS y, CAST(entity % 7 AS DOUBLE) AS x FROM fx_dim WHERE lat IS NOT NULL),
lx AS (SELECT a.entity, ANY_VALUE(a.y) AS y, ANY_VALUE(a.x) AS x, AVG(b.x) AS wx FROM nd a JOIN kn ON kn.src = a.entity JOIN nd b ON b.entity = kn.dst GROUP BY a.entity),
cm AS (SELECT COUNT(*) AS n, VAR_POP(x) * COUNT(*) AS a, COVAR_POP(x, wx) * COUNT(*) AS b, VAR_POP(wx) * COUNT(*) AS c, COVAR_POP(x, y) * COUNT(*) AS p, COVAR_POP(wx, y) * COUNT(*) AS q, VAR_POP(y) * COUNT(*) AS yy, AVG(y) AS my, AVG(x) AS mx, AVG(wx) AS mw FROM lx),
bb AS (SELECT *, (c * p - b * q) / (a * c - b * b) AS b1, (a * q - b * p) / (a * c - b * b) AS b2, a * c - b * b AS det FROM cm),
ss AS (SELECT *, (yy - b1 * p - b2 * q) / (n - 3) AS s2 FROM bb)"""


@query("slx", f"""WITH {SLX}
SELECT 'const' AS term, {R('my - b1 * mx - b2 * mw', 5)} AS coef, {R('SQRT(s2 * (1.0 / n + (mx * mx * c - 2 * mx * mw * b + mw * mw * a) / det))', 5)} AS std_err FROM ss
UNION ALL SELECT 'x', {R('b1', 5)}, {R('SQRT(s2 * c / det)', 5)} FROM ss UNION ALL SELECT 'W_x', {R('b2', 5)}, {R('SQRT(s2 * a / det)', 5)} FROM ss""")
def slx(spark, sf):
    nodes = _nodes(spark, sf)
    fit = S.slx(nodes, W.knn_weights(nodes, 6), "y", ["x"])
    return plain(fit.table(spark).select("term", "coef", "std_err"), 5)


_S = lambda a, b: f"(COVAR_POP({a}, {b}) * COUNT(*))"  # centred sum of products
LAGGED = f"""{_knn_sql('plane', 6)}, nd AS (SELECT entity, last_year - first_year + lat AS y, CAST(entity % 7 AS DOUBLE) AS x FROM fx_dim WHERE lat IS NOT NULL),
l1 AS MATERIALIZED (SELECT a.entity, ANY_VALUE(a.y) AS y, ANY_VALUE(a.x) AS x, AVG(b.y) AS wy, AVG(b.x) AS wx FROM nd a JOIN kn ON kn.src = a.entity JOIN nd b ON b.entity = kn.dst GROUP BY a.entity),
l2 AS MATERIALIZED (SELECT a.*, q.wwx, q.wwy FROM l1 a JOIN (SELECT kn.src AS e, AVG(b.wx) AS wwx, AVG(b.wy) AS wwy FROM kn JOIN l1 b ON b.entity = kn.dst GROUP BY kn.src) q ON q.e = a.entity)"""
LIMIT_5 = 3.841458820694124  # chi-square with one degree of freedom, five per cent


def _lm_sql(form, lag, err, robust_lag, robust_error, source):
    stats = f"{form}_s AS (SELECT {lag} AS lag, {err} AS err, {robust_lag} AS rl, {robust_error} AS re FROM {source})"
    choice = f"CASE WHEN rl > {LIMIT_5} AND rl > re THEN 'lag' WHEN re > {LIMIT_5} AND re > rl THEN 'error' WHEN lag > {LIMIT_5} AND err > {LIMIT_5} THEN 'sdm' ELSE 'ols' END"
    rows = " UNION ALL ".join(
        f"SELECT '{form}' AS form, '{name}' AS test, {R(c, 5)} AS stat, {L(f'CASE WHEN {c} > {LIMIT_5} THEN 1 ELSE 0 END')} AS significant, {choice} AS choice FROM {form}_s"
        for name, c in (("lm_lag", "lag"), ("lm_error", "err"), ("robust_lag", "rl"), ("robust_error", "re")))
    return stats, rows


_REF = _lm_sql("reference", "e_wy * e_wy / rwy", "e_we * e_we / (we_we * (n - 2))", *2 * (
    "POW((e_wy - e_we) / ee, 2) / (s2 / rwy + s2 / we_we)",), "(SELECT *, ee / (n - 2) AS s2 FROM c)")
_ANS = _lm_sql("anselin", "dl * dl / nj", "de * de / tr", "POW(dl - de, 2) / (nj - tr)", "POW(de - tr / nj * dl, 2) / (tr * (1 - tr / nj))",
               "(SELECT *, e_wy / s2 AS dl, e_we / s2 AS de, rwxb / s2 + tr AS nj FROM (SELECT *, ee / n AS s2 FROM c))")


@query("lm_tests", f"""WITH {LAGGED}, f AS (SELECT REGR_SLOPE(y, x) AS b, REGR_INTERCEPT(y, x) AS a FROM l1),
r AS (SELECT y - a - b * x AS e, wy - a - b * wx AS we, a + b * wx AS wxb, x, wy FROM l1, f),
pw AS (SELECT COUNT(*) / 6.0 AS bw FROM kn GROUP BY LEAST(src, dst), GREATEST(src, dst)),
c AS (SELECT COUNT(*) * 1.0 AS n, SUM(e * e) AS ee, SUM(e * wy) AS e_wy, SUM(e * we) AS e_we, SUM(we * we) AS we_we,
  {_S('wy', 'wy')} - POW({_S('x', 'wy')}, 2) / {_S('x', 'x')} AS rwy, {_S('wxb', 'wxb')} - POW({_S('x', 'wxb')}, 2) / {_S('x', 'x')} AS rwxb, (SELECT SUM(bw * bw) FROM pw) AS tr FROM r),
{_REF[0]}, {_ANS[0]} {_REF[1]} UNION ALL {_ANS[1]}""")
def lm_tests(spark, sf):
    nodes = _nodes(spark, sf)
    w = cut(W.knn_weights(nodes, 6))
    rows = []
    for form in ("anselin", "reference"):
        got = S.lm_tests(nodes, w, "y", ["x"], form=form)
        rows += [(form, k, got[k], int(got[f"{k}_p"] < 0.05), S.choose_model(got)) for k in ("lm_lag", "lm_error", "robust_lag", "robust_error")]
    return plain(spark.createDataFrame(rows, "form string, test string, stat double, significant long, choice string"), 5)


# two-stage least squares with as many instruments as unknowns: H'Zb = H'y, here after taking means off
SAR = f"""sm AS (SELECT COUNT(*) * 1.0 AS n, AVG(y) AS my, AVG(x) AS mx, AVG(wy) AS mw, {_S('x', 'x')} AS a11, {_S('x', 'wy')} AS a12, {_S('wx', 'x')} AS a21, {_S('wx', 'wy')} AS a22,
  {_S('x', 'wx')} AS c12, {_S('wx', 'wx')} AS c22, {_S('x', 'y')} AS p, {_S('wx', 'y')} AS q FROM l2),
sb AS (SELECT *, a11 * a22 - a12 * a21 AS det, (p * a22 - a12 * q) / (a11 * a22 - a12 * a21) AS b, (a11 * q - a21 * p) / (a11 * a22 - a12 * a21) AS rho FROM sm),
sr AS (SELECT SUM(POW(y - (my - b * mx - rho * mw) - b * x - rho * wy, 2)) / ANY_VALUE(n) AS s2 FROM l2, sb),
sv AS (SELECT *, (a22 * a22 * a11 - 2 * a22 * a12 * c12 + a12 * a12 * c22) / (det * det) AS v11, (a21 * a21 * a11 - 2 * a21 * a11 * c12 + a11 * a11 * c22) / (det * det) AS v22,
  (-a22 * a21 * a11 + (a22 * a11 + a12 * a21) * c12 - a12 * a11 * c22) / (det * det) AS v12 FROM sb, sr)"""


@query("sar_2sls", f"""WITH {LAGGED}, {SAR}
SELECT 'const' AS term, {R('my - b * mx - rho * mw', 5)} AS coef, {R('SQRT(s2 * (1 / n + mx * mx * v11 + 2 * mx * mw * v12 + mw * mw * v22))', 5)} AS std_err FROM sv
UNION ALL SELECT 'x', {R('b', 5)}, {R('SQRT(s2 * v11)', 5)} FROM sv UNION ALL SELECT 'rho', {R('rho', 5)}, {R('SQRT(s2 * v22)', 5)} FROM sv""")
def sar_2sls(spark, sf):
    nodes = _nodes(spark, sf)
    return plain(S.sar_2sls(nodes, cut(W.knn_weights(nodes, 6)), "y", ["x"]).table(spark).select("term", "coef", "std_err"), 5)


def _lambda_sql(levels=5, points=200):
    """CTEs down to ``sl`` (lam): the minimum of the moment loss over ever finer grids."""
    loss = """(POW(s1 - d1 - g1 * k, 2) + POW(s2 - d2 - g2 * k, 2) + POW(s3 - d3 - g3 * k, 2))"""
    ctes = [f"""uf AS (SELECT REGR_SLOPE(y, x) AS b, REGR_INTERCEPT(y, x) AS a FROM l2),
uu AS (SELECT y - a - b * x AS u, wy - a - b * wx AS v, wwy - a - b * wwx AS w FROM l2, uf),
um AS (SELECT AVG(u * u) AS s1, AVG(v * v) AS s2, AVG(u * v) AS s3, AVG(v * w) AS vw, AVG(w * w) AS ww, AVG(u * w) AS uw, CAST(1.0 AS DOUBLE) AS g1, CAST(1.0 AS DOUBLE) / 6 AS g2, CAST(0.0 AS DOUBLE) AS g3 FROM uu),
sl0 AS (SELECT CAST(0.0 AS DOUBLE) AS lam)"""]
    half = 0.99
    for i in range(levels):
        ctes.append(f"""gr{i} AS (SELECT lam + CAST({half!r} AS DOUBLE) * j / {points} AS lam FROM sl{i}, (SELECT UNNEST(RANGE(-{points}, {points + 1})) AS j)),
dr{i} AS (SELECT *, 2 * s3 * lam - s2 * lam * lam AS d1, 2 * vw * lam - ww * lam * lam AS d2, (uw + s2) * lam - vw * lam * lam AS d3 FROM gr{i}, um),
kr{i} AS (SELECT *, (g1 * (s1 - d1) + g2 * (s2 - d2) + g3 * (s3 - d3)) / (g1 * g1 + g2 * g2 + g3 * g3) AS k FROM dr{i}),
sl{i + 1} AS MATERIALIZED (SELECT ARG_MIN(lam, {loss}) AS lam FROM kr{i})""")
        half = half / points * 2
    return ",\n".join(ctes) + f",\nsl AS (SELECT lam FROM sl{levels})"


SEM = f"""{_lambda_sql()},
sf AS (SELECT y - lam * wy AS y, x - lam * wx AS x, lam FROM l2, sl),
se AS (SELECT ANY_VALUE(lam) AS lam, COUNT(*) * 1.0 AS n, REGR_SLOPE(y, x) AS b, REGR_INTERCEPT(y, x) AS a, REGR_SXX(y, x) AS sxx, AVG(x) AS mx, (1 - REGR_R2(y, x)) * REGR_SYY(y, x) / (COUNT(*) - 2) AS s2 FROM sf)"""


@query("sem_gmm", f"""WITH {LAGGED}, {SEM}
SELECT 'const' AS term, {R('a / (1 - lam)', 4)} AS coef, {R('SQRT(s2 * (1 / n + mx * mx / sxx)) / (1 - lam)', 4)} AS std_err FROM se
UNION ALL SELECT 'x', {R('b', 4)}, {R('SQRT(s2 / sxx)', 4)} FROM se UNION ALL SELECT 'lambda', {R('lam', 4)}, {R('0', 4)} FROM se""")
def sem_gmm(spark, sf):
    nodes = _nodes(spark, sf)
    return plain(S.sem_gmm(nodes, cut(W.knn_weights(nodes, 6)), "y", ["x"]).table(spark).select("term", "coef", "std_err"), 4)


# the lag's own instrument (WWx) freed of x and Wx gives rho, then x and Wx follow by least squares
SDM = f"""dm AS (SELECT {_S('x', 'x')} AS a, {_S('x', 'wx')} AS b, {_S('wx', 'wx')} AS c, {_S('x', 'wwx')} AS p, {_S('wx', 'wwx')} AS q, AVG(x) AS mx, AVG(wx) AS mw, AVG(wwx) AS mz FROM l2),
dz AS (SELECT y, x, wx, wy, wwx - mz - (c * p - b * q) / (a * c - b * b) * (x - mx) - (a * q - b * p) / (a * c - b * b) * (wx - mw) AS z FROM l2, dm),
dp AS (SELECT SUM(z * y) / SUM(z * wy) AS rho FROM dz),
dy AS (SELECT y - rho * wy AS t, x, wx, rho FROM l2, dp),
dn AS (SELECT ANY_VALUE(rho) AS rho, {_S('x', 'x')} AS a, {_S('x', 'wx')} AS b, {_S('wx', 'wx')} AS c, {_S('x', 't')} AS p, {_S('wx', 't')} AS q FROM dy),
db AS (SELECT rho, (c * p - b * q) / (a * c - b * b) AS bx, (a * q - b * p) / (a * c - b * b) AS bw FROM dn)"""


@query("effect_split", f"""WITH {LAGGED}, {SAR}, {SEM}, {SDM},
ef AS (SELECT 'sar' AS model, b / (1 - rho) AS direct, b * rho / POW(1 - rho, 2) AS spillover, rho FROM sv UNION ALL SELECT 'sem', b, 0, 0 FROM se
UNION ALL SELECT 'sdm', bx / (1 - rho), (bx + bw) * rho / POW(1 - rho, 2), rho FROM db)
SELECT model, {R('direct', 3)} AS direct, {R('spillover', 3)} AS spillover, {R('direct + spillover', 3)} AS total, {R('spillover / (direct + spillover)', 3)} AS share FROM ef WHERE ABS(rho) < 0.99""")
def effect_split(spark, sf):
    nodes = _nodes(spark, sf)
    w = cut(W.knn_weights(nodes, 6))
    models = {"sar": S.sar_2sls(nodes, w, "y", ["x"]), "sem": S.sem_gmm(nodes, w, "y", ["x"]), "sdm": S.sar_2sls(nodes, w, "y", ["x"], durbin=True)}
    rows = [tuple(r.values()) for r in S.split_effects(models, "x")]
    return plain(spark.createDataFrame(rows, "model string, direct double, spillover double, total double, share double"), 3)


@query("spatial_entity_cs", f"""
WITH {TREATED}, g AS (SELECT b.entity, CASE WHEN LAG(b.value) OVER w > 0 THEN LEAST(GREATEST((b.value - LAG(b.value) OVER w) / LAG(b.value) OVER w, -0.5), 0.5) END AS y, strength, treated, d.lat, d.lng FROM b JOIN fx_dim d ON d.entity = b.entity WINDOW w AS (PARTITION BY b.entity ORDER BY b.year))
SELECT {L('entity')} AS id, {R('AVG(lat)')} AS lat, {R('AVG(lng)')} AS lng, {R('AVG(y)')} AS y, {R('MAX(strength)')} AS strength, {R('MAX(treated)')} AS treated FROM g WHERE y IS NOT NULL AND lat IS NOT NULL GROUP BY entity""")
def spatial_entity_cs(spark, sf):
    p = N.growth_abs(_treated(spark, sf), "value", "entity", "year").join(view(spark, sf, "fx_dim").select("entity", "lat", "lng"), "entity")
    return plain(J.entity_cross_section(p, "entity", "lat", "lng"))


# --- hazards -----------------------------------------------------------------------------------


def risk_panel(spark, sf):
    return N.person_period(view(spark, sf, "fx_dim"), keep=["class", "region", "bank", "lat", "lng"])


LEVELS = ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")  # after the base level
_DUMMIES = ", ".join(f"CASE WHEN class = '{v}' THEN 1.0 ELSE 0.0 END AS x{{{i}}}" for i, v in enumerate(LEVELS))
_CLASS = lambda first: _DUMMIES.format(*range(first, first + len(LEVELS)))
_CLOGLOG = f"""{PERSON}, {kept_sample('pp', 'event', ['entity', 'year'])},
md AS (SELECT MEDIAN(age) AS age, MEDIAN(lat) AS lat FROM ks),
ds AS MATERIALIZED (SELECT 0 AS w, 1.0 AS wt, event * 1.0 AS e, 1.0 AS x0, CAST(COALESCE(k.age, md.age) AS DOUBLE) AS x1, COALESCE(k.lat, md.lat) AS x2, {_CLASS(3)} FROM ks k, md),
{fisher_steps('ds', 7, 'cloglog')},
ll AS (SELECT SUM(CASE WHEN e = 1 THEN LN(p) ELSE LN(1 - p) END) AS ll, SUM(e) AS ev, COUNT(*) AS n FROM (SELECT e, 1 - EXP(-EXP({' + '.join(f'b{i} * x{i}' for i in range(7))})) AS p FROM ds, bt)),
st AS (SELECT -2 * ll + 14 AS aic, 1 - ll / (ev * LN(ev / n) + (n - ev) * LN(1 - ev / n)) AS r2 FROM ll)"""
_TERMS = [("age", "numeric", "age", 1), ("lat", "numeric", "lat", 2), *[(f"class_{v}", "class", v, 3 + i) for i, v in enumerate(LEVELS)], ("Intercept", "intercept", "Intercept", 0)]


@query("cloglog_glm", f"WITH {_CLOGLOG} " + " UNION ALL ".join(
    f"""SELECT '{t}' AS term, '{k}' AS kind, '{v}' AS level, {R(f'b{i}', 5)} AS coef, {R(f's{i}', 5)} AS se,
{R(f'b{i} - 1.959963984540054 * s{i}', 5)} AS lo, {R(f'b{i} + 1.959963984540054 * s{i}', 5)} AS hi, {R('aic', 4)} AS aic, {R('r2', 5)} AS pseudo_r2 FROM bt, st""" for t, k, v, i in _TERMS))
def cloglog_glm(spark, sf):
    fit = H.fit_cloglog(cut(H.keep_events(risk_panel(spark, sf), "event", ["entity", "year"])), "event", ["age", "lat"], ["class"])
    out = fit.table(spark).drop("p").withColumns({"aic": F.round(F.lit(fit.stats["aic"]), 4), "pseudo_r2": F.lit(fit.stats["pseudo_r2"])})
    return plain(out, 5)


_TEST = f"{hash_draw('entity', 'year')} < 0.2 * CAST({1 << 52} AS DOUBLE)"
_FILLED = ", ".join(f"COALESCE(CAST(tt.{c} AS DOUBLE), md.{c}) AS {c}" for c in ("age", "lat", "lng"))
_LOGIT = f"""{PERSON}, tt AS MATERIALIZED (SELECT *, {_TEST} AS test FROM pp),
md AS (SELECT MEDIAN(age) AS age, MEDIAN(lat) AS lat, MEDIAN(lng) AS lng FROM tt WHERE NOT test),
fl AS (SELECT test, event, class, {_FILLED} FROM tt, md),
sc AS (SELECT STDDEV_POP(age) AS a, STDDEV_POP(lat) AS b, STDDEV_POP(lng) AS c, COUNT(*) * 1.0 AS n, SUM(event) * 1.0 AS ev FROM fl WHERE NOT test),
al AS MATERIALIZED (SELECT 0 AS w, test, CASE WHEN event = 1 THEN n / (2 * ev) ELSE n / (2 * (n - ev)) END AS wt, event * 1.0 AS e, 1.0 AS x0, age / a AS x1, lat / b AS x2, lng / c AS x3, {_CLASS(4)} FROM fl, sc),
ds AS MATERIALIZED (SELECT * FROM al WHERE NOT test),
{fisher_steps('ds', 8, 'logit', ridge=0.0001)},
sr AS MATERIALIZED (SELECT e, 1 / (1 + EXP(-({' + '.join(f'b{i} * x{i}' for i in range(8))}))) AS risk FROM al, bt WHERE test),
rk AS (SELECT e, RANK() OVER (ORDER BY risk) + (COUNT(*) OVER (PARTITION BY risk) - 1) / 2.0 AS r FROM sr),
au AS (SELECT (SUM(e * r) - SUM(e) * (SUM(e) + 1) / 2) / (SUM(e) * (COUNT(*) - SUM(e))) AS auc, (SELECT AVG(POW(risk - e, 2)) FROM sr) AS brier FROM rk)"""
_LOGIT_TERMS = [("age", "numeric", "age", 1), ("lat", "numeric", "lat", 2), ("lng", "numeric", "lng", 3), *[(f"class_{v}", "class", v, 4 + i) for i, v in enumerate(LEVELS)], ("Intercept", "intercept", "Intercept", 0)]


@query("logit_hazard", f"WITH {_LOGIT} " + " UNION ALL ".join(
    f"""SELECT '{t}' AS term, '{k}' AS kind, '{v}' AS level, {R(f'b{i}', 4)} AS coef, {R(f's{i}', 4)} AS se, {R('auc', 4)} AS test_auc, {R('brier', 4)} AS test_brier FROM bt, au""" for t, k, v, i in _LOGIT_TERMS))
def logit_hazard(spark, sf):
    train, test = H.split_rows(cut(risk_panel(spark, sf)), ["entity", "year"])
    fit = H.fit_logit(train, "event", ["age", "lat", "lng"], ["class"])
    got = H.metrics(cut(fit.predict(test)), "event")
    return plain(fit.table(spark).select("term", "kind", "level", "coef", "se", F.lit(got["auc"]).alias("test_auc"), F.lit(got["brier"]).alias("test_brier")), 4)


@query("risk_design", f"""WITH {PERSON} SELECT * FROM (VALUES ('age', 'numeric'), ('bank', 'numeric'), ('lat', 'numeric'), ('lng', 'numeric'), ('class', 'factor'), ('year', 'factor')) v(term, kind), (SELECT {L('COUNT(*)')} AS rows FROM pp)""")
def risk_design(spark, sf):
    p = risk_panel(spark, sf)
    numeric, factors, _ = H.risk_design(p, "event", ["entity", "region"], "class", "year")
    terms = [(c, "numeric") for c in numeric if c != "right_censored"] + [(c, "factor") for c in factors]
    rows = p.agg(F.count("*").alias("rows")).withColumn("_one", F.lit(1))
    return plain(spark.createDataFrame(terms, "term string, kind string").withColumn("_one", F.lit(1)).join(rows, "_one").drop("_one"))


_ROLLING = f"""{PERSON}, ye AS (SELECT year, SUM(event) AS e, SUM(SUM(event)) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pp GROUP BY year),
wi AS (SELECT year AS w FROM ye WHERE {{windows}}),
tr AS (SELECT wi.w, pp.* FROM pp JOIN wi ON {{train}}), {kept_sample('tr', 'event', ['entity', 'year'], 'w')},
md AS (SELECT w, MEDIAN(age) AS age, MEDIAN(lat) AS lat FROM ks GROUP BY w),
dx AS (SELECT k.w, 1.0 AS wt, event * 1.0 AS e, 1.0 AS x0, CAST(COALESCE(k.age, md.age) AS DOUBLE) AS x1, COALESCE(k.lat, md.lat) AS x2, {_CLASS(3)} FROM ks k JOIN md ON md.w = k.w),
ds AS MATERIALIZED (SELECT * FROM dx),
{fisher_steps('ds', 7, 'cloglog', rounds=14)},
te AS (SELECT md.w, event * 1.0 AS e, 1.0 AS x0, CAST(COALESCE(pp.age, md.age) AS DOUBLE) AS x1, COALESCE(pp.lat, md.lat) AS x2, {_CLASS(3)} FROM md JOIN pp ON {{test}}),
sr AS MATERIALIZED (SELECT te.w, e, 1 - EXP(-EXP({' + '.join(f'b{i} * x{i}' for i in range(7))})) AS risk FROM te JOIN bt ON bt.w = te.w),
rk AS (SELECT w, e, risk, LEAST(GREATEST(risk, 1e-6), 1 - 1e-6) AS p, RANK() OVER (PARTITION BY w ORDER BY risk) + (COUNT(*) OVER (PARTITION BY w, risk) - 1) / 2.0 AS r FROM sr)
SELECT {L('w')} AS year, {L('COUNT(*)')} AS n, {L('SUM(e)')} AS events, {R('(SUM(e * r) - SUM(e) * (SUM(e) + 1) / 2) / (SUM(e) * (COUNT(*) - SUM(e)))', 4)} AS auc, {R('AVG(POW(risk - e, 2))', 4)} AS brier,
  {R('AVG(CASE WHEN e = 1 THEN -LN(p) ELSE -LN(1 - p) END)', 4)} AS log_loss, CAST(0 AS BIGINT) AS n_dropped_unseen_level FROM rk GROUP BY w"""
_OOT = "year long, n long, events long, auc double, brier double, log_loss double, n_dropped_unseen_level long"


def _oot_rows(spark, rows):
    return plain(spark.createDataFrame([(int(r["year"]), int(r["n"]), int(r["events"]), r["auc"], r["brier"], r["log_loss"], int(r["n_dropped_unseen_level"])) for r in rows], _OOT), 4)


@query("rolling_oot", "WITH " + _ROLLING.format(windows="before >= 12 AND e >= 5", train="pp.year < wi.w", test="pp.year = md.w"))
def rolling_oot(spark, sf):
    rows, _ = H.rolling_out_of_time(risk_panel(spark, sf), "event", "year", ["entity", "year"], ["age", "lat"], ["class"], 12, 5)
    return _oot_rows(spark, rows)


@query("holdout_oot", "WITH " + _ROLLING.format(windows="year = 2000", train="pp.year <= wi.w", test="pp.year > md.w"))
def holdout_oot(spark, sf):
    got = H.holdout(risk_panel(spark, sf), "event", "year", 2000, ["entity", "year"], ["age", "lat"], ["class"])
    return _oot_rows(spark, [{"year": 2000, **got}])


# --- jobs --------------------------------------------------------------------------------------


@query("job_workflow", f"""
SELECT {L('COUNT(*)')} AS before_rows, {L('COUNT(amount)')} AS after_rows, {L('COUNT(*) - COUNT(amount)')} AS removed_rows,
  (SELECT {L('CASE WHEN COUNT(*) > COUNT(DISTINCT id) THEN 1 ELSE 0 END + CASE WHEN MIN(GREATEST(amount, 0)) < 0 THEN 1 ELSE 0 END')} FROM fx_dirty WHERE amount IS NOT NULL) AS failed,
  (SELECT {L('COUNT(DISTINCT year)')} FROM fx_dirty) AS years FROM fx_dirty""")
def job_workflow(spark, sf):
    from geostrata.operators.clean import CleanPlan
    from geostrata.operators.mapping import MappingScheme

    plan = CleanPlan().drop_na(["amount"]).clip("amount", 0.0)
    checks = [{"name": "no negatives", "check": "no_negative", "field": "amount", "severity": "P0"}, {"name": "unique", "check": "unique", "field": "id", "severity": "P1"}]
    got = J.run_workflow(view(spark, sf, "fx_dirty"), "id", plan=plan, assertions=checks, scheme=MappingScheme().aggregate(["year"], {"amount": "sum"}), order_by=["id", "copy"])
    tag = lambda d: d.withColumn("_one", F.lit(1))
    failed = got.report.agg(F.sum(F.when(F.col("status") == "fail", 1).otherwise(0)).alias("failed"))
    years = got.mapped.data.agg(F.count("*").alias("years"))
    return plain(tag(got.cleaned.stats).join(tag(failed), "_one").join(tag(years), "_one").drop("_one"))


@query("job_closures")
def job_closures(spark, sf):
    got = J.run_closures(view(spark, sf, "fx_panel"), view(spark, sf, "fx_dim"))
    rows = [("twfe", *r[:3]) for r in got.twfe.rows()] + [("event_study", f"tau {r[0]}", r[1], r[2]) for r in got.event_rows]
    rows += [("slx", *r[:3]) for r in got.spatial["slx"].rows()] + [("sar", *r[:3]) for r in got.spatial["sar"].rows()]
    rows.append(("resid_moran", "moran_i", got.spatial["resid_moran"]["moran_i"], None))
    return plain(spark.createDataFrame(rows, "model string, term string, coef double, std_err double"), 5)


@query("job_survival")
def job_survival(spark, sf):
    got = J.run_survival(view(spark, sf, "fx_dim"))
    rows = [(k, float(v)) for k, v in got.test_metrics.items() if v is not None] + [(f"moran_{k}", float(v)) for k, v in got.residual_moran.items() if v is not None]
    rows += [("cloglog_pseudo_r2", got.cloglog.stats["pseudo_r2"]), ("rows", float(got.panel.count()))]
    return plain(spark.createDataFrame(rows, "metric string, value double"), 4)


@query("job_ladder", f"""
WITH p AS (SELECT {L('COUNT(*)')} AS n FROM fx_points), d AS (SELECT {L('COUNT(lat)')} AS n FROM fx_dim)
SELECT 'points' AS dataset, n AS points, CAST(0 AS BIGINT) AS bad_rows FROM p UNION ALL SELECT 'entities', n, CAST(0 AS BIGINT) FROM d""")
def job_ladder(spark, sf):
    sets = {"points": view(spark, sf, "fx_points").select("lat", F.col("lng").alias("lon"), "value"),
            "entities": view(spark, sf, "fx_dim").select("lat", F.col("lng").alias("lon"), F.when(F.col("acq_year").isNotNull(), 1.0).otherwise(0.0).alias("value"))}
    got, _ = J.run_ladder(sets)
    return plain(spark.createDataFrame([(n, int(t.points), int(t.weights_summary["bad_rows"])) for n, t in got.items()], "dataset string, points long, bad_rows long"))


@query("job_analyze", f"""
WITH k AS (SELECT COUNT(*) AS n, COUNT(*) - COUNT(DISTINCT (entity, year)) AS dups, COUNT(DISTINCT entity) AS entities FROM fx_panel),
e AS (SELECT AVG(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END) AS rep FROM (SELECT entity, COUNT(DISTINCT year) AS n FROM fx_panel GROUP BY entity))
SELECT 'entity' AS entity, {R('2 + 8 * rep - CASE WHEN rep < 0.05 THEN 6 ELSE 0 END')} AS entity_score, 'year' AS time,
CASE WHEN dups = 0 THEN 'panel' ELSE 'repeated_panel' END AS kind, {L('dups')} AS dups, {L('n')} AS rows FROM k, e WHERE entities >= 20""")
def job_analyze(spark, sf):
    got = J.run_analyze(spark, view(spark, sf, "fx_panel"))
    roles, shape = got["roles"], got["shape"]
    scale = got["health"].filter("key = 'scale'").select(F.col("value").alias("rows"))
    return plain(scale.select(
        F.lit(roles["entity"]).alias("entity"), F.lit(got["scores"]["entity"][roles["entity"]]).alias("entity_score"), F.lit(roles["time"]).alias("time"),
        F.lit(shape["kind"]).alias("kind"), F.lit(shape["dup_entity_time"]).alias("dups"), F.col("rows").cast("long").alias("rows")))


@query("job_refit")
def job_refit(spark, sf):
    d = _treated(spark, sf).select("entity", "year", "value", "n_orders", "mark", "s").join(view(spark, sf, "fx_dim").select("entity", "lat", "lng", "class"), "entity")
    roles = {"entity": "entity", "time": "year", "value": "value", "lat": "lat", "lon": "lng", "group": "class"}
    got = J.run_refit(cut(d), roles, mark="mark", strength="s", exit_col="mark")
    rows = [("twfe", *r[:3]) for r in got["twfe"].rows()] + [("slx", *r[:3]) for r in got["spatial"]["slx"].rows()]
    rows += [("risk", r[0], r[3], r[4]) for r in got["risk"].rows]
    return plain(spark.createDataFrame(rows, "model string, term string, coef double, std_err double"), 4)


_ROW = "(cell % 8388608 - 4194304)"
_X = f"((CAST(FLOOR(cell / 8388608) AS BIGINT) - 4194304) + {_ROW} / 2.0) * SQRT(3) * {HEX_EDGE_KM[7]!r}"
CELL_NODES = f"""{CELLS}, rv AS (SELECT cell, SUM(CASE WHEN year = 1996 THEN value END) AS v0, SUM(CASE WHEN year = 1999 THEN value END) AS v1
  FROM fx_panel p JOIN hc ON hc.entity = p.entity WHERE year IN (1996, 1999) GROUP BY cell),
cs AS MATERIALIZED (SELECT cell, LEAST(GREATEST(v1 / v0 - 1, -0.5), 0.5) AS g, DEGREES({_ROW} * 1.5 * {HEX_EDGE_KM[7]!r} / {EARTH_RADIUS_KM!r}) AS lat,
  DEGREES({_X} / ({EARTH_RADIUS_KM!r} * COS(RADIANS(37.0)))) AS lng FROM rv WHERE v0 IS NOT NULL AND v1 IS NOT NULL AND v0 <> 0)"""


@query("moran_residual", f"""
WITH {CELL_NODES}, {_knn_sql('plane', 6, 'cs', 'cell')}, z AS (SELECT cell, g - AVG(g) OVER () AS z FROM cs),
l AS (SELECT a.cell, ANY_VALUE(a.z) AS z, AVG(b.z) AS wz FROM z a JOIN kn ON kn.src = a.cell JOIN z b ON b.cell = kn.dst GROUP BY a.cell),
p AS (SELECT COUNT(*) / 6.0 AS bw FROM kn GROUP BY LEAST(src, dst), GREATEST(src, dst)),
d AS (SELECT SUM(c) AS t FROM (SELECT src AS id, 1.0 AS c FROM kn WHERE rk = 1 UNION ALL SELECT dst, 1 / 6.0 FROM kn) GROUP BY id),
c AS (SELECT COUNT(*) * 1.0 AS n, SUM(z * wz) / SUM(z * z) AS i, COUNT(*) * SUM(POW(z, 4)) / POW(SUM(z * z), 2) AS k, (SELECT SUM(bw * bw) FROM p) AS s1, (SELECT SUM(t * t) FROM d) AS s2 FROM l),
v AS (SELECT *, -1 / (n - 1) AS e, (n * n * s1 - n * s2 + 3 * n * n) / ((n * n - 1) * n * n) - 1 / POW(n - 1, 2) AS vn,
  (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * n * n) - k * ((n * n - n) * s1 - 2 * n * s2 + 6 * n * n)) / ((n - 1) * (n - 2) * (n - 3) * n * n) - 1 / POW(n - 1, 2) AS vr FROM c)
SELECT {L('n')} AS n, {R('i')} AS moran_i, {R('e')} AS e_i, {R('vn')} AS var_norm, {R('(i - e) / SQRT(vn)', 5)} AS z_norm, {R('vr')} AS var_rand, {R('(i - e) / SQRT(vr)', 5)} AS z_rand FROM v""")
def moran_residual(spark, sf):
    lat, lng = hex_center("cell", 7)
    cs = cut(cross_section(spark, sf).withColumns({"lat": lat, "lng": lng}))
    got = M.moran_inference(cs, W.knn_weights(cs, 6, "cell"), "growth_clip", "cell")
    return plain(got.select("n", "moran_i", "e_i", "var_norm", F.round("z_norm", 5).alias("z_norm"), "var_rand", F.round("z_rand", 5).alias("z_rand")))
