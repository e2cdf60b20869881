"""Model evaluation, survival curves and panel health."""

from pyspark.sql import functions as F

from geostrata.operators import evaluate as E
from geostrata.operators import hazard as H
from geostrata.queries.registry import L, R, plain, query, table, view
from geostrata.queries.sqltext import kept_sample


def _score(spark, sf):
    return view(spark, sf, "fx_score")


@query("auc", f"""
WITH r AS (SELECT event, RANK() OVER (ORDER BY risk) + (COUNT(*) OVER (PARTITION BY risk) - 1) / 2.0 AS rk FROM fx_score)
SELECT {R('(SUM(CASE WHEN event = 1 THEN rk END) - SUM(event) * (SUM(event) + 1) / 2.0) / (SUM(event) * (COUNT(*) - SUM(event)))', 9)} AS auc FROM r""")
def auc(spark, sf):
    return plain(E.auc(_score(spark, sf), "event", "risk"), 9)


@query("brier", f"SELECT {R('AVG((risk - event) * (risk - event))')} AS brier FROM fx_score")
def brier(spark, sf):
    return plain(E.brier(_score(spark, sf), "event", "risk"))


@query("log_loss", f"""SELECT {R('AVG(-(event * LN(LEAST(GREATEST(risk, 1e-6), 1 - 1e-6)) + (1 - event) * LN(1 - LEAST(GREATEST(risk, 1e-6), 1 - 1e-6))))')} AS log_loss FROM fx_score""")
def log_loss(spark, sf):
    return plain(E.log_loss(_score(spark, sf), "event", "risk"))


def _c_sql(good):
    return f"""
WITH g AS (SELECT duration AS t, risk AS s, COUNT(*) AS n, SUM(event) AS e FROM fx_score GROUP BY 1, 2)
SELECT {R(f'SUM(a.e * b.n * {good}) / SUM(a.e * b.n)', 9)} AS c_index FROM g a JOIN g b ON b.t > a.t AND a.e > 0"""


@query("c_index", _c_sql("CASE WHEN b.s < a.s THEN 1.0 ELSE 0.0 END"))
def c_index(spark, sf):
    return plain(E.c_index(_score(spark, sf), "risk", "duration", "event"), 9)


@query("c_index_half_ties", _c_sql("CASE WHEN b.s < a.s THEN 1.0 WHEN b.s = a.s THEN 0.5 ELSE 0.0 END"))
def c_index_half_ties(spark, sf):
    return plain(E.c_index(_score(spark, sf), "risk", "duration", "event", "half"), 9)


@query("roc_curve", f"""
WITH g AS (SELECT risk, SUM(event) AS p, COUNT(*) - SUM(event) AS q FROM fx_score GROUP BY risk),
c AS (SELECT risk, SUM(p) OVER w * 1.0 / (SELECT SUM(p) FROM g) AS tpr, SUM(q) OVER w * 1.0 / (SELECT SUM(q) FROM g) AS fpr FROM g WINDOW w AS (ORDER BY risk DESC))
SELECT {R('risk')} AS threshold, {R('tpr')} AS tpr, {R('fpr')} AS fpr FROM c
UNION ALL SELECT 2, 0, 0 UNION ALL SELECT -1, 1, 1""")
def roc_curve(spark, sf):
    got = E.roc_curve(_score(spark, sf), "event", "risk")
    ends = F.when(F.col("threshold") > 1e300, 2.0).when(F.col("threshold") < -1e300, -1.0).otherwise(F.col("threshold"))
    return plain(got.withColumn("threshold", ends))


@query("roc_curve_points", f"""
WITH k AS (SELECT DISTINCT q FROM (SELECT UNNEST(QUANTILE_CONT(risk, [{', '.join(str(i / 20) for i in range(21))}])) AS q FROM fx_score))
SELECT {R('q')} AS threshold, {R('SUM(CASE WHEN risk >= q THEN event ELSE 0 END) * 1.0 / SUM(event)')} AS tpr,
  {R('SUM(CASE WHEN risk >= q THEN 1 - event ELSE 0 END) * 1.0 / SUM(1 - event)')} AS fpr FROM fx_score, k GROUP BY q""")
def roc_curve_points(spark, sf):
    return plain(E.roc_curve(_score(spark, sf), "event", "risk", 21).filter("abs(threshold) < 1e300"))


def _bins_sql(x, n, src):
    qs = ", ".join(str(i / n) for i in range(n + 1))
    return f"""k AS (SELECT DISTINCT q FROM (SELECT UNNEST(QUANTILE_CONT({x}, [{qs}])) AS q FROM {src})),
bn AS (SELECT s.*, GREATEST((SELECT COUNT(*) FROM k WHERE k.q < s.{x} AND k.q < (SELECT MAX(q) FROM k)) - 1, 0) AS bin FROM {src} s)"""


@query("calibration_bins", f"""
WITH {_bins_sql('risk', 10, 'fx_score')}
SELECT {L('bin')} AS bin, {R('AVG(risk)')} AS predicted, {R('AVG(event)')} AS observed, {L('COUNT(*)')} AS n FROM bn GROUP BY bin""")
def calibration_bins(spark, sf):
    return plain(E.calibration_bins(_score(spark, sf), "event", "risk"))


@query("qcut_curve", f"""
WITH {_bins_sql('value', 20, 'fx_points')}
SELECT {L('bin')} AS bin, {R('AVG(value)')} AS x_mean, {R('AVG(lat)')} AS y_mean, {R('STDDEV_SAMP(lat) / SQRT(COUNT(*))')} AS y_sem, {L('COUNT(*)')} AS n FROM bn GROUP BY bin""")
def qcut_curve(spark, sf):
    return plain(E.qcut_curve(view(spark, sf, "fx_points"), "value", "lat", 20))


def _km_sql(group, keep):
    return f"""
WITH g AS (SELECT {group} AS grp, duration AS t, COUNT(*) AS n, SUM(event) AS d FROM fx_score GROUP BY 1, 2),
r AS (SELECT *, SUM(n) OVER (PARTITION BY grp ORDER BY t DESC) AS at_risk FROM g)
SELECT grp, {L('t')} AS t, {L('at_risk')} AS at_risk, {L('d')} AS events,
  {R('CASE WHEN MAX(CASE WHEN d = at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE EXP(SUM(CASE WHEN d = at_risk THEN 0 ELSE LN(1 - d * 1.0 / at_risk) END) OVER w) END')} AS survival
FROM r WHERE {keep} WINDOW w AS (PARTITION BY grp ORDER BY t)"""


@query("kaplan_meier", _km_sql("'all'", "d > 0"))
def kaplan_meier(spark, sf):
    return plain(E.kaplan_meier(_score(spark, sf), "duration", "event"))


@query("kaplan_meier_by_group", _km_sql("grp", "t > 0"))
def kaplan_meier_by_group(spark, sf):
    return plain(E.kaplan_meier(_score(spark, sf), "duration", "event", "grp", event_times_only=False))


@query("hazard_by_year", f"""
WITH y AS (SELECT UNNEST(RANGE((SELECT MIN(first_year) FROM fx_dim), (SELECT MAX(COALESCE(acq_year, last_year)) FROM fx_dim) + 1)) AS year),
c AS (SELECT y.year, SUM(CASE WHEN first_year <= y.year AND COALESCE(acq_year, last_year) >= y.year THEN 1 ELSE 0 END) AS r, SUM(CASE WHEN acq_year = y.year THEN 1 ELSE 0 END) AS k FROM y, fx_dim GROUP BY 1)
SELECT {L('year')} AS year, {L('r')} AS at_risk, {L('k')} AS closed, {R('CASE WHEN r > 0 THEN k * 1.0 / r END')} AS rate FROM c""")
def hazard_by_year(spark, sf):
    return plain(E.hazard_by_year(view(spark, sf, "fx_dim"), "first_year", "last_year", "acq_year"))


@query("ecdf", f"""
WITH p AS (SELECT value AS x FROM fx_points WHERE value > 0)
SELECT {R('x')} AS x, {R('MAX(c)')} AS share FROM (SELECT x, CUME_DIST() OVER (ORDER BY x) AS c FROM p) GROUP BY x""")
def ecdf(spark, sf):
    return plain(E.ecdf(view(spark, sf, "fx_points"), "value"))


@query("top_share", f"""
WITH p AS (SELECT value AS x, ROW_NUMBER() OVER (ORDER BY value DESC) AS r, COUNT(*) OVER () AS n FROM fx_points WHERE value > 0)
SELECT {R('SUM(CASE WHEN r <= GREATEST(1, n // 10) THEN x ELSE 0 END) / SUM(x)')} AS top_share FROM p""")
def top_share(spark, sf):
    return plain(E.top_share(view(spark, sf, "fx_points"), "value"))


@query("risk_hist", f"""
WITH m AS (SELECT MAX(risk) / 33 AS w FROM fx_score)
SELECT {L('year')} AS year, {L('LEAST(FLOOR(risk / w), 32)')} AS bin, {L('COUNT(*)')} AS n FROM fx_score, m GROUP BY 1, 2""")
def risk_hist(spark, sf):
    return plain(E.risk_histogram(_score(spark, sf), "risk", "year"))


LEAKY = """lk AS (SELECT p.entity, p.year, p.value, p.n_orders, d.bank AS bank_closed_rate, d.region, COALESCE(d.acq_year, 0) AS dep_last FROM fx_panel p JOIN fx_dim d ON d.entity = p.entity)"""


def _leaky(spark, sf):
    d = view(spark, sf, "fx_dim").select("entity", F.col("bank").alias("bank_closed_rate"), "region", F.coalesce("acq_year", F.lit(0)).alias("dep_last"))
    return view(spark, sf, "fx_panel").join(d, "entity")


@query("leak_scan", f"""
WITH {LEAKY}, e AS (SELECT entity, {', '.join(f'MIN({c}) = MAX({c}) AS {c}' for c in ('value', 'n_orders', 'bank_closed_rate', 'region', 'dep_last'))} FROM lk GROUP BY entity)
SELECT * FROM ({' UNION ALL '.join(f"SELECT '{c}' AS field, {R(f'AVG(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)', 4)} AS entity_constant_rate, CAST({h} AS BIGINT) AS name_hint FROM e" for c, h in (('value', 0), ('n_orders', 1), ('bank_closed_rate', 1), ('region', 0), ('dep_last', 1)))})
WHERE entity_constant_rate >= 0.95""")
def leak_scan(spark, sf):
    return plain(E.leak_scan(_leaky(spark, sf), "entity", "year"))


BALANCE = """u AS (SELECT DISTINCT entity, year FROM fx_panel), pt AS (SELECT year, COUNT(*) AS n FROM u GROUP BY 1), pe AS (SELECT entity, COUNT(*) AS k FROM u GROUP BY 1)"""


@query("panel_balance", f"""
WITH {BALANCE} SELECT (SELECT {L('COUNT(*)')} FROM pt) AS periods, (SELECT {L('MIN(n)')} FROM pt) AS min_entities, (SELECT {L('MAX(n)')} FROM pt) AS max_entities, {L('COUNT(*)')} AS entities,
  {R('AVG(CASE WHEN k <= 1 THEN 1.0 ELSE 0.0 END)')} AS single_period_share, {R('AVG(CASE WHEN k >= (SELECT COUNT(*) FROM pt) THEN 1.0 ELSE 0.0 END)')} AS full_span_share, {R('MEDIAN(k)')} AS periods_per_entity_median FROM pe""")
def panel_balance(spark, sf):
    return plain(E.panel_balance(view(spark, sf, "fx_panel"), "entity", "year"))


@query("missing_concentration", " UNION ALL ".join(f"""
SELECT '{c}' AS field, {R('SUM(z) / SUM(n)')} AS overall, {R('MAX(z * 1.0 / n)')} AS worst_period, {R('MAX(z * 1.0 / n) / (SUM(z) / SUM(n))')} AS concentration
FROM (SELECT year, COUNT(*) AS n, SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS z FROM fx_dirty GROUP BY year)""" for c in ("amount", "cat")))
def missing_concentration(spark, sf):
    return plain(E.missing_concentration(view(spark, sf, "fx_dirty"), "year", ["amount", "cat"]))


@query("health_checks", f"""
WITH {LEAKY}, {BALANCE}, j AS (SELECT lk.*, d.lat, d.lng FROM lk JOIN fx_dim d ON d.entity = lk.entity)
SELECT 'scale' AS key, 'ok' AS level, {R('COUNT(*)')} AS value FROM j
UNION ALL SELECT 'geo', CASE WHEN AVG(CASE WHEN lat IS NULL OR lng IS NULL THEN 1.0 ELSE 0.0 END) <= 0.2 THEN 'ok' ELSE 'danger' END, {R('AVG(CASE WHEN lat IS NULL OR lng IS NULL THEN 1.0 ELSE 0.0 END)')} FROM j
UNION ALL SELECT 'span', CASE WHEN MAX(year) - MIN(year) + 1 >= 5 THEN 'ok' ELSE 'danger' END, {R('MAX(year) - MIN(year) + 1')} FROM j
UNION ALL SELECT 'key', 'warn', {R('COUNT(DISTINCT entity)')} FROM j
UNION ALL SELECT 'outcome', 'ok', {R('AVG(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END)')} FROM j
UNION ALL SELECT 'panel', 'ok', {R('AVG(CASE WHEN k >= (SELECT COUNT(*) FROM pt) THEN 1.0 ELSE 0.0 END)')} FROM pe
UNION ALL SELECT 'leakage', 'warn', {R('COUNT(*) * 0 + 5')} FROM j""")
def health_checks(spark, sf):
    d = _leaky(spark, sf).join(view(spark, sf, "fx_dim").select("entity", "lat", "lng"), "entity")
    roles = {"entity": "entity", "time": "year", "lat": "lat", "lon": "lng", "value": "value"}
    return plain(E.health_checks(d, roles, "panel"))


@query("sample_keep_events", f"""
WITH {kept_sample('fx_score', 'event', ['entity'])}
SELECT {L('entity')} AS entity, {L('event')} AS event FROM ks""")
def sample_keep_events(spark, sf):
    return plain(H.keep_events(_score(spark, sf), "event", ["entity"], 2).select("entity", "event"))


COEF_SQL = """ct AS (SELECT 'year_' || CAST(year AS VARCHAR) AS term, 'year' AS kind, AVG(risk) - 0.5 AS coef, STDDEV_SAMP(risk) * 40 AS se, AVG(event) / 6 AS p FROM fx_score GROUP BY year
UNION ALL SELECT grp, 'grp', AVG(risk) * 12 - 5, STDDEV_SAMP(risk), AVG(event) / 6 FROM fx_score GROUP BY grp)"""


def _coefs(spark, sf):
    s = _score(spark, sf)
    years = s.groupBy(F.concat(F.lit("year_"), F.col("year").cast("string")).alias("term")).agg(
        F.lit("year").alias("kind"), (F.avg("risk") - 0.5).alias("coef"), (F.stddev_samp("risk") * 40).alias("se"), (F.avg("event") / 6).alias("p"))
    grps = s.groupBy(F.col("grp").alias("term")).agg(
        F.lit("grp").alias("kind"), (F.avg("risk") * 12 - 5).alias("coef"), F.stddev_samp("risk").alias("se"), (F.avg("event") / 6).alias("p"))
    both = years.unionByName(grps)
    return both.withColumns({"lo": F.col("coef") - 1.96 * F.col("se"), "hi": F.col("coef") + 1.96 * F.col("se")})


@query("exp_coef", f"WITH {COEF_SQL} SELECT SUBSTR(term, 6) AS level, {R('coef')} AS coef, {R('EXP(coef)')} AS exp_coef FROM ct WHERE kind = 'year'")
def exp_coef(spark, sf):
    return plain(E.exp_coefficients(_coefs(spark, sf), "year_"))


@query("degenerate_flag", f"WITH {COEF_SQL} SELECT term, {L('CASE WHEN ABS(coef) > 0.9 OR se > 11.7 THEN 1 ELSE 0 END')} AS degenerate FROM ct")
def degenerate_flag(spark, sf):
    return plain(H.degenerate_flag(_coefs(spark, sf), 0.9, 11.7).select("term", "degenerate"))


@query("coef_forest", f"""WITH {COEF_SQL} SELECT term, {R('coef')} AS coef FROM ct WHERE kind <> 'year' AND p < 0.05 AND 2 * 1.96 * se < 5 ORDER BY coef DESC LIMIT 14""")
def coef_forest(spark, sf):
    return plain(H.coef_forest(_coefs(spark, sf)).select("term", "coef"))


@query("linear_shap", f"""
WITH m AS (SELECT AVG(o_totalprice) AS a, AVG(o_custkey) AS b FROM orders)
SELECT 'price' AS feature, {R('AVG(ABS((o_totalprice - a) * 0.0001))')} AS mean_abs_shap FROM orders, m
UNION ALL SELECT 'customer', {R('AVG(ABS((o_custkey - b) * -0.01))')} FROM orders, m""")
def linear_shap(spark, sf):
    return plain(H.linear_shap(table(spark, sf, "orders"), {"o_totalprice": 0.0001, "o_custkey": -0.01}, {"o_totalprice": "price", "o_custkey": "customer"}))


MODEL = [
    {"kind": "intercept", "level": "Intercept", "coef": -2.0}, {"kind": "numeric", "level": "duration", "coef": 0.1},
    {"kind": "numeric", "level": "risk", "coef": 1.5}, {"kind": "grp", "level": "BUILDING", "coef": 0.3}, {"kind": "grp", "level": "MACHINERY", "coef": -0.4},
]


@query("score_hazard", f"""
WITH s AS (SELECT *, CASE WHEN year NOT BETWEEN 1996 AND 2000 THEN 'year out of range' WHEN grp = 'HOUSEHOLD' THEN 'degenerate level' ELSE 'ok' END AS status,
  -2.0 + 0.1 * duration + 1.5 * risk + CASE grp WHEN 'BUILDING' THEN 0.3 WHEN 'MACHINERY' THEN -0.4 ELSE 0 END AS eta FROM fx_score)
SELECT {L('entity')} AS entity, status, {R("CASE WHEN status = 'ok' THEN eta END")} AS eta, {R("CASE WHEN status = 'ok' THEN 1 - EXP(-EXP(eta)) END")} AS hazard,
  {R("CASE WHEN status = 'ok' THEN 1 - EXP(-EXP(eta - 1.5 * risk)) END")} AS hazard_conservative FROM s""")
def score_hazard(spark, sf):
    got = H.score_hazard(_score(spark, sf), MODEL, ["duration", "risk"], ["grp"], "year", (1996, 2000), {"grp": ["HOUSEHOLD"]}, ["risk"])
    return plain(got.select("entity", "status", "eta", "hazard", "hazard_conservative"))


def _newton_sql(rounds=12):
    """Newton steps on the intercept, written out."""
    ctes = ["n0 AS (SELECT CAST(0 AS DOUBLE) AS b)"]
    p = "(1 / (1 + EXP(-(risk + b))))"
    for i in range(rounds):
        ctes.append(f"n{i + 1} AS MATERIALIZED (SELECT ANY_VALUE(b) - (AVG({p}) - AVG(event)) / AVG({p} * (1 - {p})) AS b FROM fx_score, n{i})")
    return f"WITH {', '.join(ctes)} SELECT {R('ANY_VALUE(b)')} AS intercept, {R(f'AVG({p})')} AS mean_predicted, {R('AVG(event)')} AS event_rate FROM fx_score, n{rounds}"


@query("calibrate_intercept", _newton_sql())
def calibrate_intercept(spark, sf):
    s = _score(spark, sf)
    b = H.calibrate_intercept(s, "risk", "event")
    p = 1 / (1 + F.exp(-(F.col("risk") + F.lit(b))))
    return plain(s.agg(F.lit(b).alias("intercept"), F.avg(p).alias("mean_predicted"), F.avg("event").alias("event_rate")))


@query("evidence_grade", f"""
WITH r AS (SELECT grp, year, AVG(risk) * 4 AS t, AVG(event) * 2 AS ratio, MOD(year, 3) AS m FROM fx_score GROUP BY 1, 2),
a AS (SELECT *, CASE m WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END AS st FROM r)
SELECT grp, {L('year')} AS year, CASE WHEN ratio >= 0.5 THEN 'C' ELSE SUBSTR('ABC', CAST(CASE WHEN t >= 1.96 THEN LEAST(st + 1, 3) ELSE st END AS INTEGER), 1) END AS grade,
  CASE m WHEN 0 THEN 'exogenous' WHEN 1 THEN 'endogenous' ELSE 'exogeneity unknown' END || '; ' || CASE WHEN t >= 1.96 THEN 'pre-trend significant' ELSE 'pre-trend acceptable' END
  || CASE WHEN ratio >= 0.5 THEN '; pre-trend close to effect' ELSE '' END AS reasons FROM a""")
def evidence_grade(spark, sf):
    m = F.col("year") % 3
    runs = _score(spark, sf).groupBy("grp", "year").agg((F.avg("risk") * 4).alias("pre_trend_t"), (F.avg("event") * 2).alias("pre_trend_ratio")).withColumn(
        "exogenous", F.when(m == 0, F.lit(True)).when(m == 1, F.lit(False)))
    return plain(E.evidence_grade(runs).select("grp", "year", "grade", "reasons"))
