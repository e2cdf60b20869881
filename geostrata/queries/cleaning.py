"""Cleaning steps, plans and their logs."""

from pyspark.sql import functions as F

from geostrata.operators import clean as C
from geostrata.queries.registry import L, R, plain, query, view

KEY = "id, copy"


def _dirty(spark, sf):
    return view(spark, sf, "fx_dirty")


def _out(df, *cols):
    return plain(df.select("id", "copy", *cols))


def _sql(expr, where=""):
    return f"SELECT {L('id')} AS id, {L('copy')} AS copy, {expr} FROM fx_dirty {where}"


@query("clean_drop_na", _sql(f"{R('amount')} AS amount, cat", "WHERE amount IS NOT NULL AND cat IS NOT NULL"))
def clean_drop_na(spark, sf):
    return _out(C.drop_na(_dirty(spark, sf), ["amount", "cat"]), "amount", "cat")


@query("clean_fill_const", _sql("COALESCE(cat, 'UNKNOWN') AS cat"))
def clean_fill_const(spark, sf):
    return _out(C.fill(_dirty(spark, sf), "cat", "constant", "UNKNOWN"), "cat")


@query("clean_fill_mean", _sql(f"{R('COALESCE(amount, (SELECT AVG(amount) FROM fx_dirty))', 4)} AS amount"))
def clean_fill_mean(spark, sf):
    return plain(C.fill(_dirty(spark, sf), "amount", "mean").select("id", "copy", "amount"), 4)


@query("clean_fill_median", _sql(f"{R('COALESCE(amount, (SELECT MEDIAN(amount) FROM fx_dirty))')} AS amount"))
def clean_fill_median(spark, sf):
    return _out(C.fill(_dirty(spark, sf), "amount", "median"), "amount")


@query("clean_fill_mode", """
WITH m AS (SELECT cat FROM fx_dirty WHERE cat IS NOT NULL GROUP BY cat ORDER BY COUNT(*) DESC, cat LIMIT 1)
""" + _sql("COALESCE(cat, (SELECT cat FROM m)) AS cat"))
def clean_fill_mode(spark, sf):
    return _out(C.fill(_dirty(spark, sf), "cat", "mode"), "cat")


@query("clean_ffill", _sql("LAST_VALUE(cat IGNORE NULLS) OVER (ORDER BY year, id, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cat"))
def clean_ffill(spark, sf):
    return _out(C.fill(_dirty(spark, sf), "cat", "ffill", order_by=["year", "id", "copy"]), "cat")


@query("clean_bfill", _sql(f"{R('FIRST_VALUE(amount IGNORE NULLS) OVER (PARTITION BY year ORDER BY num_text, id, copy ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS amount"))
def clean_bfill(spark, sf):
    return _out(C.fill(_dirty(spark, sf), "amount", "bfill", order_by=["num_text", "id", "copy"], partition_by=["year"]), "amount")


@query("clean_clip", _sql(f"{R('CASE WHEN amount < 0 THEN 0 WHEN amount > 400000 THEN 400000 ELSE amount END')} AS amount"))
def clean_clip(spark, sf):
    return _out(C.clip(_dirty(spark, sf), "amount", 0.0, 400000.0), "amount")


@query("clean_clip_to_null", _sql(f"{R('CASE WHEN lat BETWEEN -90 AND 90 THEN lat END')} AS lat"))
def clean_clip_to_null(spark, sf):
    return _out(C.clip(_dirty(spark, sf), "lat", -90.0, 90.0, "to_null"), "lat")


@query("clean_replace", _sql("CASE WHEN num_text = 'n/a' THEN '0' ELSE num_text END AS num_text"))
def clean_replace(spark, sf):
    return _out(C.replace(_dirty(spark, sf), "num_text", "n/a", "0"), "num_text")


def _dedup_sql(direction):
    return f"""
WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity, year ORDER BY id {direction}, copy {direction}) AS rn FROM fx_dirty)
SELECT {L('id')} AS id, {L('copy')} AS copy, {L('entity')} AS entity, {L('year')} AS year, {R('amount')} AS amount FROM r WHERE rn = 1"""


@query("clean_dedup_first", _dedup_sql("ASC"))
def clean_dedup_first(spark, sf):
    d = C.deduplicate(_dirty(spark, sf), ["entity", "year"], ["id", "copy"], "first")
    return _out(d, "entity", "year", "amount")


@query("clean_dedup_last", _dedup_sql("DESC"))
def clean_dedup_last(spark, sf):
    d = C.deduplicate(_dirty(spark, sf), ["entity", "year"], ["id", "copy"], "last")
    return _out(d, "entity", "year", "amount")


@query("clean_astype", _sql("CAST(year AS VARCHAR) AS year_text"))
def clean_astype(spark, sf):
    got = C.clean(_dirty(spark, sf), C.CleanPlan().astype("year", "string"))
    return _out(got.data.withColumnRenamed("year", "year_text"), "year_text")


@query("clean_winsorize", f"""
WITH b AS (SELECT QUANTILE_CONT(amount, 0.05) AS lo, QUANTILE_CONT(amount, 0.95) AS hi FROM fx_dirty)
SELECT {L('id')} AS id, {L('copy')} AS copy, {R('CASE WHEN amount IS NULL THEN NULL ELSE LEAST(GREATEST(amount, lo), hi) END')} AS amount FROM fx_dirty, b""")
def clean_winsorize(spark, sf):
    return _out(C.winsorize(_dirty(spark, sf), "amount", 0.05), "amount")


@query("clean_drop_columns", f"SELECT {L('id')} AS id, {L('copy')} AS copy, {L('year')} AS year, cat FROM fx_dirty")
def clean_drop_columns(spark, sf):
    got = C.clean(_dirty(spark, sf), C.CleanPlan().drop_columns(["entity", "amount", "lat", "num_text"]))
    return plain(got.data)


@query("clean_filter", _sql(f"{R('amount')} AS amount", "WHERE amount > 0 AND year >= 1997"))
def clean_filter(spark, sf):
    got = C.clean(_dirty(spark, sf), C.CleanPlan().filter("amount > 0").filter(lambda d: F.col("year") >= 1997))
    return _out(got.data, "amount")


SPEC = [
    {"op": "drop_na", "field": ["amount"], "reason": "no amount"},
    {"op": "clip", "field": "amount", "lower": 0.0, "reason": "negative"},
    {"op": "clip", "field": "lat", "lower": -90.0, "upper": 90.0, "on_violation": "to_null", "reason": "off the globe"},
    {"op": "fill", "field": "cat", "method": "constant", "value": "UNKNOWN", "reason": "no class"},
    {"op": "replace", "field": "num_text", "to_replace": "n/a", "value": "0", "reason": "text"},
    {"op": "drop_duplicates", "subset": ["id"], "keep": "first", "reason": "copies"},
    {"op": "astype", "field": "num_text", "dtype": "bigint", "reason": "number"},
]

PLAN_CTE = """s1 AS (SELECT * FROM fx_dirty WHERE amount IS NOT NULL),
s6 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY id, copy) AS rn FROM s1),
lg AS (
SELECT 1 AS step, 'drop_na' AS action, 'amount' AS field, (SELECT COUNT(*) FROM fx_dirty WHERE amount IS NULL) AS n
UNION ALL SELECT 2, 'clip', 'amount', (SELECT COUNT(*) FROM s1 WHERE amount < 0)
UNION ALL SELECT 3, 'clip_to_null', 'lat', (SELECT COUNT(*) FROM s1 WHERE lat < -90 OR lat > 90)
UNION ALL SELECT 4, 'fill', 'cat', (SELECT COUNT(*) FROM s1 WHERE cat IS NULL)
UNION ALL SELECT 5, 'replace', 'num_text', (SELECT COUNT(*) FROM s1 WHERE num_text = 'n/a')
UNION ALL SELECT 6, 'drop_duplicates', 'id', (SELECT COUNT(*) FROM s6 WHERE rn > 1)
UNION ALL SELECT 7, 'astype', 'num_text', (SELECT COUNT(*) FROM s6 WHERE rn = 1))"""


def _planned(spark, sf):
    return C.clean(_dirty(spark, sf), C.CleanPlan.from_spec(SPEC), order_by=["id", "copy"])


@query("clean_plan", f"""
WITH {PLAN_CTE}
SELECT {L('id')} AS id, {L('copy')} AS copy, {R('GREATEST(amount, 0)')} AS amount, COALESCE(cat, 'UNKNOWN') AS cat,
       {R('CASE WHEN lat BETWEEN -90 AND 90 THEN lat END')} AS lat, {L("CASE WHEN num_text = 'n/a' THEN '0' ELSE num_text END")} AS num_text
FROM s6 WHERE rn = 1""")
def clean_plan(spark, sf):
    return _out(_planned(spark, sf).data, "amount", "cat", "lat", "num_text")


@query("clean_log", f"WITH {PLAN_CTE} SELECT {L('step')} AS step, action, field, {L('n')} AS affected_rows FROM lg")
def clean_log(spark, sf):
    return plain(_planned(spark, sf).log.select("step", "action", "field", "affected_rows"))


@query("clean_stats", f"""
WITH {PLAN_CTE} SELECT (SELECT {L('COUNT(*)')} FROM fx_dirty) AS before_rows, {L('COUNT(*)')} AS after_rows,
  {L('(SELECT COUNT(*) FROM fx_dirty) - COUNT(*)')} AS removed_rows FROM s6 WHERE rn = 1""")
def clean_stats(spark, sf):
    return plain(_planned(spark, sf).stats)


@query("clean_impact_by_op", f"""
WITH {PLAN_CTE} SELECT action, {L('COUNT(*)')} AS steps, {L('SUM(n)')} AS affected_rows FROM lg GROUP BY action""")
def clean_impact_by_op(spark, sf):
    return plain(C.impact_by_action(_planned(spark, sf).log))


@query("clean_impact_by_field", f"WITH {PLAN_CTE} SELECT field, " + ", ".join(
    f"{L(f'COALESCE(SUM(CASE WHEN action = {chr(39)}{a}{chr(39)} THEN n END), 0)')} AS {n}" for a, n in C.IMPACT.items()) + " FROM lg GROUP BY field")
def clean_impact_by_field(spark, sf):
    return plain(C.impact_by_field(_planned(spark, sf).log))


@query("clean_forbidden", f"""
WITH {PLAN_CTE} SELECT {L('step')} AS step, action, field, {L('n')} AS affected_rows FROM lg
WHERE (action = 'fill' AND field = 'cat') OR (action = 'clip' AND field = 'lat')""")
def clean_forbidden(spark, sf):
    return plain(C.forbidden_hits(_planned(spark, sf).log, [("fill", "cat"), ("clip", "lat"), ("drop_na", "amo")])).select(
        "step", "action", "field", "affected_rows")
