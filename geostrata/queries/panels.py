"""Panels, dimensions, risk sets and treatment."""

from pyspark.sql import functions as F

from geostrata.functions.columns import hex_cell, square_cell
from geostrata.operators import panel as N
from geostrata.operators.rings import event_counts, first_exposure
from geostrata.queries.registry import L, R, plain, query, view
from geostrata.queries.sqltext import FIRST_EXPOSURE, HEX_CELL, HEX_DISK

PREV = "WITH p AS (SELECT *, LAG(value) OVER (PARTITION BY entity ORDER BY year) AS prev FROM fx_panel)"


@query("panel_growth", f"""{PREV} SELECT {L('entity')} AS entity, {L('year')} AS year, {R('value - prev')} AS chg,
  {R('CASE WHEN prev > 0 THEN (value - prev) / prev END')} AS chg_rate FROM p""")
def panel_growth(spark, sf):
    return plain(N.growth(view(spark, sf, "fx_panel"), "value", "entity", "year").select("entity", "year", "chg", "chg_rate"))


@query("panel_growth_abs", f"""{PREV} SELECT {L('entity')} AS entity, {L('year')} AS year,
  {R('CASE WHEN prev IS NULL OR prev = 0 THEN NULL ELSE LEAST(GREATEST((value - prev) / ABS(prev), -0.5), 0.5) END')} AS y FROM p""")
def panel_growth_abs(spark, sf):
    return plain(N.growth_abs(view(spark, sf, "fx_panel"), "value", "entity", "year").select("entity", "year", "y"))


def _gappy(spark, sf):
    d = view(spark, sf, "fx_panel")
    return d.withColumn("value", F.when((F.col("entity") + F.col("year")) % 4 != 0, F.col("value")))


GAPPY = "WITH g AS (SELECT entity, year, CASE WHEN (entity + year) % 4 <> 0 THEN value END AS value, n_orders FROM fx_panel)"


@query("dim_last_row", f"""{GAPPY} SELECT {L('entity')} AS entity, {L('MIN(year)')} AS first_year, {L('MAX(year)')} AS last_year,
  {R('MAX(CASE WHEN year = fy THEN value END)')} AS value_first, {R('MAX(CASE WHEN year = ly THEN value END)')} AS value_last
FROM (SELECT *, MIN(CASE WHEN value IS NOT NULL THEN year END) OVER (PARTITION BY entity) AS fy, MAX(year) OVER (PARTITION BY entity) AS ly FROM g) GROUP BY entity""")
def dim_last_row(spark, sf):
    return plain(N.dim_last_row(_gappy(spark, sf), "entity", "year", ["value"], ["value"]))


@query("dim_last_valid", f"""{GAPPY} SELECT {L('entity')} AS entity, {L('MIN(year)')} AS first_year, {L('MAX(year)')} AS last_year,
  {L('MIN(n_orders)')} AS est_year, {L('MAX(n_orders)')} AS acq_year, {R('MAX(CASE WHEN year = fy THEN value END)')} AS value_first, {R('MAX(CASE WHEN year = ly THEN value END)')} AS value_last
FROM (SELECT *, MIN(CASE WHEN value IS NOT NULL THEN year END) OVER (PARTITION BY entity) AS fy, MAX(CASE WHEN value IS NOT NULL THEN year END) OVER (PARTITION BY entity) AS ly FROM g) GROUP BY entity""")
def dim_last_valid(spark, sf):
    return plain(N.dim_last_valid(_gappy(spark, sf), "entity", "year", ["value"], ["value"], "n_orders", "n_orders"))


@query("event_type", f"""SELECT {L('entity')} AS entity, CASE WHEN acq_year IS NOT NULL THEN 'closed'
  WHEN last_year >= (SELECT MAX(last_year) FROM fx_dim) THEN 'alive' ELSE 'attrition' END AS event_type FROM fx_dim""")
def event_type(spark, sf):
    d = view(spark, sf, "fx_dim")
    end = d.agg(F.max("last_year")).first()[0]
    return plain(d.select("entity", N.event_type("acq_year", "last_year", end).alias("event_type")))


@query("surv_fields", f"""SELECT {L('entity')} AS entity, {L('COALESCE(acq_year, last_year)')} AS obs_end, {L('GREATEST(1, COALESCE(acq_year, last_year) - first_year + 1)')} AS duration,
  {L('CASE WHEN acq_year IS NULL THEN 1 ELSE 0 END')} AS right_censored, CASE WHEN acq_year IS NULL THEN 'alive' ELSE 'closed' END AS event,
  {L('CASE WHEN est_year IS NULL OR est_year < 1995 THEN 1 ELSE 0 END')} AS left_truncated, {L('last_year - COALESCE(est_year, first_year)')} AS age, {L('last_year - first_year + 1')} AS alive_years FROM fx_dim""")
def surv_fields(spark, sf):
    d = N.survival_fields(view(spark, sf, "fx_dim"), 1995)
    return plain(d.select("entity", "obs_end", "duration", "right_censored", "event", "left_truncated", "age", "alive_years"))


@query("local_density", f"""WITH c AS (SELECT entity, FLOOR(lat / 0.05) AS a, FLOOR(lng / 0.05) AS b FROM fx_dim)
SELECT {L('c.entity')} AS entity, {L('CASE WHEN a IS NULL THEN 0 ELSE COUNT(*) OVER (PARTITION BY a, b) END')} AS neighbor_count FROM c""")
def local_density(spark, sf):
    d = view(spark, sf, "fx_dim").withColumn("cell", square_cell("lat", "lng", 0.05))
    return plain(N.local_density(d, "cell").select("entity", "neighbor_count"))


@query("group_fragility", f"""
WITH g AS (SELECT bank, COUNT(*) AS n, SUM(CASE WHEN acq_year IS NOT NULL THEN 1 ELSE 0 END) AS nc,
  ROUND(SQRT(STDDEV_SAMP(lat) * STDDEV_SAMP(lat) + STDDEV_SAMP(lng) * STDDEV_SAMP(lng)), 9) AS sp, SUM(last_year) AS total FROM fx_dim GROUP BY bank),
m AS (SELECT MEDIAN(sp) AS med FROM g WHERE n > 1)
SELECT {L('bank')} AS bank, {L('n')} AS n_branches, {L('nc')} AS n_closed, {R('sp')} AS geo_spread, {L('total')} AS total, {R('nc * 1.0 / n')} AS closed_rate,
  CASE WHEN n = 1 THEN 'single' WHEN sp < med THEN 'concentrated' ELSE 'dispersed' END AS tier FROM g, m""")
def group_fragility(spark, sf):
    g = N.group_fragility(view(spark, sf, "fx_dim"), "bank", F.col("acq_year").isNotNull(), total="last_year")
    return plain(g.select("bank", "n_branches", "n_closed", "geo_spread", "total", "closed_rate", "tier"))


PERSON = """pp AS (SELECT d.entity, d.class, d.region, d.bank, d.lat, d.lng, y.year, y.year - COALESCE(d.est_year, d.first_year) AS age, CASE WHEN y.year = d.acq_year THEN 1 ELSE 0 END AS event,
  CASE WHEN d.acq_year IS NULL AND y.year = COALESCE(d.acq_year, d.last_year) THEN 1 ELSE 0 END AS right_censored
  FROM fx_dim d, (SELECT UNNEST(RANGE(1980, 2021)) AS year) y WHERE (d.acq_year IS NULL OR d.acq_year >= d.first_year) AND y.year BETWEEN d.first_year AND COALESCE(d.acq_year, d.last_year))"""


@query("person_period", f"""WITH {PERSON} SELECT {L('entity')} AS entity, {L('year')} AS year, {L('age')} AS age, {L('event')} AS event, {L('right_censored')} AS right_censored FROM pp""")
def person_period(spark, sf):
    return plain(N.person_period(view(spark, sf, "fx_dim")))


@query("closed_rate_as_of", f"""WITH {PERSON}, y AS (SELECT bank, year, SUM(event) AS d, COUNT(*) AS n FROM pp GROUP BY bank, year)
SELECT {L('bank')} AS bank, {L('year')} AS year, {R('COALESCE(SUM(d) OVER w * 1.0 / SUM(n) OVER w, 0)')} AS closed_rate_before FROM y
WINDOW w AS (PARTITION BY bank ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def closed_rate_as_of(spark, sf):
    risk = N.person_period(view(spark, sf, "fx_dim"), keep=["bank"])
    return plain(N.closed_rate_as_of(risk, "bank", "year", "event"))


MARKED = "m AS (SELECT *, CASE WHEN (entity * 7 + year) % 11 = 0 THEN 1 ELSE 0 END AS mark, CAST(n_orders AS DOUBLE) / 4 AS s FROM fx_panel)"
TREATED = f"""{MARKED}, f AS (SELECT m.*, MIN(CASE WHEN mark > 0 THEN year END) OVER (PARTITION BY entity) AS fe FROM m),
a AS (SELECT *, CASE WHEN fe IS NOT NULL THEN 1 ELSE 0 END AS treated, CASE WHEN fe IS NOT NULL AND year >= fe THEN 1 ELSE 0 END AS post FROM f),
b AS (SELECT *, COALESCE(AVG(CASE WHEN post = 1 THEN s END) OVER (PARTITION BY entity), 0) AS strength FROM a)"""


def _treated(spark, sf):
    p = view(spark, sf, "fx_panel").withColumns({
        "mark": F.when((F.col("entity") * 7 + F.col("year")) % 11 == 0, 1).otherwise(0), "s": F.col("n_orders") / 4.0})
    return N.assign_treatment(p, "entity", "year", mark="mark", strength="s")


@query("treat_assign", f"""WITH {TREATED} SELECT {L('entity')} AS entity, {L('year')} AS year, {R('fe')} AS first_event_year, {L('treated')} AS treated, {L('post')} AS post,
  {R('strength')} AS strength_t0, {R('post * strength')} AS post_x_strength FROM b""")
def treat_assign(spark, sf):
    return plain(_treated(spark, sf).select("entity", "year", "first_event_year", "treated", "post", "strength_t0", "post_x_strength"))


@query("strength_support", f"""WITH {TREATED}, e AS (SELECT entity, MIN(strength) AS s, COUNT(*) AS n FROM b WHERE treated = 1 GROUP BY entity)
SELECT {L('COUNT(*)')} AS entities, {L('SUM(n)')} AS rows, {R('AVG(s)')} AS mean, {L('COUNT(DISTINCT s)')} AS distinct_values, {R('SUM(s * n) / SUM(n)')} AS row_mean, {R('MIN(s)')} AS min,
  {R('QUANTILE_CONT(s, 0.05)')} AS p05, {R('QUANTILE_CONT(s, 0.25)')} AS p25, {R('MEDIAN(s)')} AS median, {R('QUANTILE_CONT(s, 0.75)')} AS p75, {R('QUANTILE_CONT(s, 0.95)')} AS p95, {R('MAX(s)')} AS max FROM e""")
def strength_support(spark, sf):
    return plain(N.strength_support(_treated(spark, sf).withColumn("strength_t0", F.round("strength_t0", 9)), "entity"))


def did_inputs(spark, sf):
    """Panel with growth, alive entities and their first exposure to same-class closures."""
    dim = view(spark, sf, "fx_dim")
    alive = dim.filter("acq_year IS NULL AND lat IS NOT NULL")
    events = dim.filter("acq_year IS NOT NULL AND lat IS NOT NULL").withColumnRenamed("acq_year", "event_year")
    counts = event_counts(alive, events, edges=(0, 1, 3, 5, 10))
    panel = N.growth(view(spark, sf, "fx_panel"), "value", "entity", "year")
    return panel, alive, counts


def did(spark, sf):
    panel, alive, counts = did_inputs(spark, sf)
    return N.did_panel(panel, first_exposure(counts), alive, "entity", "year")


DID = FIRST_EXPOSURE + """, al AS (SELECT entity FROM fx_dim WHERE acq_year IS NULL AND lat IS NOT NULL),
gr AS (SELECT *, LAG(value) OVER (PARTITION BY entity ORDER BY year) AS prev FROM fx_panel),
dp AS (SELECT g.entity, g.year, CASE WHEN prev > 0 THEN (g.value - prev) / prev END AS chg_rate, COALESCE(e.fe, 0) AS fe, COALESCE(e.s, 0) AS s,
  CASE WHEN COALESCE(e.fe, 0) > 0 THEN 1 ELSE 0 END AS treated, CASE WHEN COALESCE(e.fe, 0) > 0 AND g.year >= e.fe THEN 1 ELSE 0 END AS post
  FROM gr g JOIN al ON al.entity = g.entity LEFT JOIN ex e ON e.entity = g.entity)"""


@query("did_panel", f"""WITH {DID} SELECT {L('entity')} AS entity, {L('year')} AS year, {R('chg_rate')} AS chg_rate, {L('fe')} AS first_event_year, {R('s')} AS strength_t0,
  {L('treated')} AS treated, {L('post')} AS post, {R('post * s')} AS post_x_strength FROM dp""")
def did_panel(spark, sf):
    return plain(did(spark, sf).select("entity", "year", "chg_rate", "first_event_year", "strength_t0", "treated", "post", "post_x_strength"))


@query("event_long", f"""WITH {DID} SELECT {L('entity')} AS entity, {L('year')} AS year, {L('year - fe')} AS tau, {R('s')} AS strength_t0, {R('s / (1 + GREATEST(year - fe, 0))')} AS strength_decay
  FROM dp WHERE treated = 1 AND year - fe BETWEEN -3 AND 4""")
def event_long(spark, sf):
    return plain(N.event_long(did(spark, sf), "year").select("entity", "year", "tau", "strength_t0", "strength_decay"))


@query("event_decay", f"""WITH {DID} SELECT {L('year - fe')} AS tau, {R('AVG(s)')} AS strength, {R('AVG(s / (1 + GREATEST(year - fe, 0)))')} AS decay
  FROM dp WHERE treated = 1 AND year - fe BETWEEN -3 AND 4 GROUP BY 1""")
def event_decay(spark, sf):
    e = N.event_long(did(spark, sf), "year")
    return plain(e.groupBy("tau").agg(F.avg("strength_t0").alias("strength"), F.avg("strength_decay").alias("decay")))


CELLS = f"hc AS (SELECT entity, acq_year, {HEX_CELL} AS cell FROM fx_dim WHERE lat IS NOT NULL)"


@query("cell_year", f"""WITH {CELLS} SELECT {L('cell')} AS cell, {L('year')} AS year, {R('SUM(value)', 3)} AS total, {L('COUNT(DISTINCT p.entity)')} AS entities
  FROM fx_panel p JOIN hc ON hc.entity = p.entity GROUP BY 1, 2""")
def cell_year(spark, sf):
    cells = view(spark, sf, "fx_dim").select("entity", hex_cell("lat", "lng", 7).alias("cell")).filter("cell is not null")
    j = view(spark, sf, "fx_panel").join(cells, "entity").groupBy("cell", "year").agg(F.sum("value").alias("total"), F.countDistinct("entity").alias("entities"))
    return plain(j.withColumn("total", F.round("total", 3)))


def cross_section(spark, sf):
    dim = view(spark, sf, "fx_dim").withColumn("cell", hex_cell("lat", "lng", 7))
    return N.cell_cross_section(view(spark, sf, "fx_panel"), dim, dim.filter("acq_year is not null"), "entity", "year", "value", 1996, 1999, (1999, 2001), k=5)


@query("cell_cross_section", f"""
WITH {CELLS}, r AS (SELECT cell, SUM(CASE WHEN year = 1996 THEN value END) AS v0, SUM(CASE WHEN year = 1999 THEN value END) AS v1, COUNT(DISTINCT CASE WHEN year = 1996 THEN p.entity END) AS nb
  FROM fx_panel p JOIN hc ON hc.entity = p.entity WHERE year IN (1996, 1999) GROUP BY cell),
ev AS (SELECT DISTINCT cell FROM hc WHERE acq_year BETWEEN 1999 AND 2001),
{HEX_DISK}, t AS (SELECT e.cell + d.o AS cell, COUNT(*) AS ts FROM ev e, disk d GROUP BY 1)
SELECT {L('r.cell')} AS cell, {R('v0', 3)} AS v1996, {R('v1', 3)} AS v1999, {L('nb')} AS n_branches, {R('v1 / v0 - 1')} AS growth, {R('LEAST(GREATEST(v1 / v0 - 1, -0.5), 0.5)')} AS growth_clip,
  {R('LN(1 + v0)')} AS log_base, {R('GREATEST(1, nb)')} AS weight, {L('COALESCE(ts, 0)')} AS treat_strength, {L('CASE WHEN COALESCE(ts, 0) > 0 THEN 1 ELSE 0 END')} AS treated
FROM r LEFT JOIN t ON t.cell = r.cell WHERE v0 IS NOT NULL AND v1 IS NOT NULL AND v0 <> 0""")
def cell_cross_section(spark, sf):
    return plain(cross_section(spark, sf).withColumns({c: F.round(c, 3) for c in ("v1996", "v1999")}))


@query("bbox_quantile", f"""
WITH b AS (SELECT QUANTILE_CONT(lat, 0.01) - 0.01 AS a0, QUANTILE_CONT(lat, 0.99) + 0.01 AS a1, QUANTILE_CONT(lng, 0.01) - 0.01 AS o0, QUANTILE_CONT(lng, 0.99) + 0.01 AS o1 FROM fx_points)
SELECT {L('CASE WHEN lat BETWEEN a0 AND a1 AND lng BETWEEN o0 AND o1 THEN 1 ELSE 0 END')} AS inside, {L('COUNT(*)')} AS n FROM fx_points, b GROUP BY 1""")
def bbox_quantile(spark, sf):
    d = N.bbox_quantile(view(spark, sf, "fx_points"), "lat", "lng", pad=0.01)
    return plain(d.groupBy("inside").agg(F.count("*").alias("n")))


@query("year_spine_counts", f"""
WITH c AS (SELECT acq_year AS year, COUNT(*) AS n FROM fx_dim WHERE acq_year IS NOT NULL AND acq_year <> 2000 GROUP BY 1),
s AS (SELECT UNNEST(RANGE((SELECT MIN(year) FROM c), (SELECT MAX(year) FROM c) + 1)) AS year)
SELECT {L('s.year')} AS year, {L('COALESCE(n, 0)')} AS n, {L('SUM(COALESCE(n, 0)) OVER (ORDER BY s.year)')} AS cumulative FROM s LEFT JOIN c ON c.year = s.year""")
def year_spine_counts(spark, sf):
    return plain(N.year_spine_counts(view(spark, sf, "fx_dim").filter("acq_year <> 2000"), "acq_year"))


@query("event_epoch", f"SELECT {L('entity')} AS entity, {L('epoch_ms(make_timestamp(acq_year, 6, 30, 0, 0, 0.0))')} AS event_ms FROM fx_dim WHERE acq_year IS NOT NULL")
def event_epoch(spark, sf):
    d = view(spark, sf, "fx_dim").filter("acq_year is not null")
    return plain(d.select("entity", N.event_epoch_ms("acq_year").alias("event_ms")))
