"""Roles and shape from content, and schema handling."""

from pyspark.sql import functions as F

from geostrata.operators import infer as I
from geostrata.operators import schema as C
from geostrata.operators import validate as V
from geostrata.operators.profile import column_counts, null_table
from geostrata.queries.registry import L, R, plain, query, table, view


def _stats_sql(c, numeric):
    v = f"TRY_CAST({c} AS DOUBLE)"
    if numeric:
        tail = f"{R(f'MIN({v})')} AS min, {R(f'MAX({v})')} AS max, {R(f'QUANTILE_CONT({v}, 0.01)')} AS q01, {R(f'QUANTILE_CONT({v}, 0.99)')} AS q99, {R(f'STDDEV_SAMP({v})', 4)} AS std, {R(f'CASE WHEN MAX(ABS({v} - ROUND({v}))) <= 1e-9 THEN 1 ELSE 0 END')} AS integer_like"
    else:
        tail = "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS q01, CAST(NULL AS DOUBLE) AS q99, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS integer_like"
    return f"""SELECT '{c}' AS "column", {L('COUNT(*)')} AS n, {L(f'COUNT({c})')} AS not_null, {R(f'1 - COUNT({c}) * 1.0 / COUNT(*)')} AS null_rate, {L(f'COUNT(DISTINCT {c})')} AS n_unique, CAST({int(numeric)} AS BIGINT) AS numeric, {tail} FROM fx_dirty"""


@query("col_stats", " UNION ALL ".join(_stats_sql(c, n) for c, n in (("id", 1), ("year", 1), ("amount", 1), ("cat", 0), ("lat", 1), ("num_text", 1))))
def col_stats(spark, sf):
    rows = I.column_stats(view(spark, sf, "fx_dirty").select("id", "year", "amount", "cat", "lat", "num_text"))
    num = lambda v: None if v is None else float(v)
    out = [(s["column"], s["n"], s["not_null"], num(s["null_rate"]), s["n_unique"], int(s["numeric"]), *[num(s[k]) for k in ("min", "max", "q01", "q99")],
            None if s["std"] is None else round(float(s["std"]), 4), num(s["integer_like"])) for s in rows]
    return plain(spark.createDataFrame(out, "column string, n long, not_null long, null_rate double, n_unique long, numeric long, min double, max double, q01 double, q99 double, std double, integer_like double"))


_CANDIDATES = " UNION ALL ".join(f"SELECT '{c}' AS c, CAST({c} AS DOUBLE) AS v, k2 AS t FROM d" for c in ("k1", "k2", "k3", "k4", "k5"))


@query("role_by_content", f"""
WITH d AS (SELECT p.entity AS k1, p.year AS k2, m.lat AS k3, m.lng * 1.5 AS k4, p.value AS k5 FROM fx_panel p JOIN fx_dim m ON p.entity = m.entity),
cells AS ({_CANDIDATES}),
s AS (SELECT c, COUNT(DISTINCT v) AS u, MIN(v) AS lo, MAX(v) AS hi, QUANTILE_CONT(v, 0.01) AS a, QUANTILE_CONT(v, 0.99) AS b, STDDEV_SAMP(v) AS sd,
  MAX(ABS(v - ROUND(v))) <= 1e-9 AS whole, COUNT(*) FILTER (WHERE v = 0) * 1.0 / COUNT(*) AS zero FROM cells GROUP BY c),
r AS (SELECT c, AVG(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END) AS rep FROM (SELECT c, v, COUNT(DISTINCT t) AS n FROM cells WHERE v IS NOT NULL GROUP BY c, v) GROUP BY c),
q AS (SELECT 'time' AS role, c, 6.0 + CASE WHEN u >= 2 THEN 2 ELSE 0 END AS score, whole, b - a AS span FROM s WHERE whole AND lo >= 1600 AND hi <= 2200
UNION ALL SELECT 'entity', s.c, 2.0 + 8 * rep - CASE WHEN rep < 0.05 THEN 6 ELSE 0 END, whole, b - a FROM s JOIN r ON r.c = s.c WHERE whole AND u >= 20
UNION ALL SELECT 'lat', c, CASE WHEN whole THEN 1.0 ELSE 3.0 END, whole, b - a FROM s WHERE a >= -90 AND b <= 90 AND b - a > 0.5
UNION ALL SELECT 'lon', c, CASE WHEN whole THEN 1.0 ELSE 3.0 END, whole, b - a FROM s WHERE a >= -180 AND b <= 180 AND b - a > 0.5
UNION ALL SELECT 'value', c, 2.0 + LEAST(2.0, LOG10(u)) - CASE WHEN zero > 0.5 THEN 1.5 ELSE 0 END, whole, b - a FROM s WHERE sd > 0 AND u >= 3
UNION ALL SELECT 'group', c, 2.0, whole, b - a FROM s WHERE NOT whole AND u BETWEEN 2 AND 60),
g1 AS (SELECT c FROM q WHERE role = 'time' ORDER BY score DESC, c LIMIT 1),
g2 AS (SELECT c FROM q WHERE role = 'entity' AND c NOT IN (SELECT c FROM g1) ORDER BY score DESC, c LIMIT 1),
used AS (SELECT c FROM g1 UNION ALL SELECT c FROM g2),
g3 AS (SELECT c, span FROM q WHERE role = 'lat' AND NOT whole AND c NOT IN (SELECT c FROM used) ORDER BY score DESC, c LIMIT 1),
g4 AS (SELECT c, span FROM q WHERE role = 'lon' AND NOT whole AND c NOT IN (SELECT c FROM used UNION ALL SELECT c FROM g3) ORDER BY score DESC, c LIMIT 1),
pair AS (SELECT g3.c AS lat, g4.c AS lon FROM g3, g4 WHERE g4.span >= g3.span),
g5 AS (SELECT c FROM q WHERE role = 'value' AND c NOT IN (SELECT c FROM used UNION ALL SELECT lat FROM pair UNION ALL SELECT lon FROM pair) ORDER BY score DESC, c LIMIT 1),
won AS (SELECT 'time' AS role, c FROM g1 UNION ALL SELECT 'entity', c FROM g2 UNION ALL SELECT 'lat', lat FROM pair UNION ALL SELECT 'lon', lon FROM pair UNION ALL SELECT 'value', c FROM g5)
SELECT q.role, q.c AS "column", {R('q.score')} AS score, CAST(CASE WHEN won.c IS NULL THEN 0 ELSE 1 END AS BIGINT) AS chosen
FROM q LEFT JOIN won ON won.role = q.role AND won.c = q.c""")
def role_by_content(spark, sf):
    d = view(spark, sf, "fx_panel").join(view(spark, sf, "fx_dim").select("entity", "lat", "lng"), "entity").select(
        F.col("entity").alias("k1"), F.col("year").alias("k2"), F.col("lat").alias("k3"), (F.col("lng") * 1.5).alias("k4"), F.col("value").alias("k5"))
    found = I.infer_mapping(d)
    rows = [(role, c, float(score), int(found[role] == c)) for role, scores in found["_scores"].items() for c, score in scores.items()]
    return plain(spark.createDataFrame(rows, "role string, column string, score double, chosen long"))


def _panel_sql(name, entity, time, frame):
    dups = f"COUNT(*) - COUNT(DISTINCT ({entity}, {time}))"
    return f"SELECT '{name}' AS source, CASE WHEN {dups} = 0 THEN 'panel' ELSE 'repeated_panel' END AS kind, {L(dups)} AS dups, {L('COUNT(*)')} AS rows FROM {frame}"


@query("shape_detect", f"""
{_panel_sql('panel', 'entity', 'year', 'fx_panel')}
UNION ALL {_panel_sql('repeated', 'o_custkey', 'year(o_orderdate)', 'orders')}
UNION ALL SELECT 'edges', CASE WHEN LEAST(COUNT(DISTINCT l_orderkey), COUNT(DISTINCT l_partkey)) >= GREATEST(50, 0.005 * COUNT(*)) THEN 'network' ELSE 'unknown' END,
  CAST(0 AS BIGINT), {L('COUNT(*)')} FROM lineitem
UNION ALL SELECT 'log', CASE WHEN COUNT(*) > 3 * COUNT(DISTINCT user_id) THEN 'event_log' ELSE 'unknown' END, CAST(0 AS BIGINT), {L('COUNT(*)')} FROM events
UNION ALL SELECT 'places', CASE WHEN COUNT(lat) > 0 THEN 'cross_section' END, CAST(0 AS BIGINT), {L('COUNT(*)')} FROM fx_dim""")
def shape_detect(spark, sf):
    sets = [
        ("panel", view(spark, sf, "fx_panel"), {"entity": "entity", "time": "year", "value": "value"}),
        ("repeated", table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice"), {"entity": "o_custkey", "time": "year"}),
        ("edges", table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), {}),
        ("log", table(spark, sf, "events").select("user_id", "value"), {"entity": "user_id", "value": "value"}),
        ("places", view(spark, sf, "fx_dim").select("lat", "lng"), {"lat": "lat", "lon": "lng"}),
    ]
    rows = []
    for name, df, roles in sets:
        shape = I.detect_shape(df, roles)
        rows.append((name, shape["kind"], shape.get("dup_entity_time", 0), df.count()))
    return plain(spark.createDataFrame(rows, "source string, kind string, dups long, rows long"))


@query("role_by_name", f"""
SELECT role, {L('COUNT(*)')} AS fields, {L('SUM(z)')} AS nulls FROM (
SELECT 'key' AS role, COUNT(*) - COUNT(id) AS z FROM fx_dirty UNION ALL SELECT 'numeric', COUNT(*) - COUNT(amount) FROM fx_dirty
UNION ALL SELECT 'spatial', COUNT(*) - COUNT(lat) FROM fx_dirty UNION ALL SELECT 'numeric', COUNT(*) - COUNT(cat) FROM fx_dirty) GROUP BY role""")
def role_by_name(spark, sf):
    d = C.tag_roles(view(spark, sf, "fx_dirty").select("id", "amount", "lat", "cat"), C.infer_roles(["id", "amount", "lat", "cat"]))
    roles = {f.name: f.metadata["role"] for f in d.schema.fields}
    return plain(null_table(d, roles).groupBy("role").agg(F.count("*").alias("fields"), F.sum("null_count").alias("nulls")))


@query("role_by_regex", f"""
SELECT 'lat' AS role, 'lat' AS field, {L('COUNT(lat)')} AS non_null FROM fx_dim UNION ALL SELECT 'lon', 'lng', {L('COUNT(lng)')} FROM fx_dim
UNION ALL SELECT 'year', 'first_year', {L('COUNT(first_year)')} FROM fx_dim""")
def role_by_regex(spark, sf):
    d = view(spark, sf, "fx_dim")
    hits = {r: c for r, c in C.detect_columns(d.columns).items() if c}
    pairs = [F.struct(F.lit(r).alias("role"), F.lit(c).alias("field"), F.count(c).alias("non_null")) for r, c in hits.items()]
    return plain(d.agg(*[F.count(c).alias(f"n_{r}") for r, c in hits.items()]).select(F.inline(F.array(*[
        F.struct(F.lit(r).alias("role"), F.lit(c).alias("field"), F.col(f"n_{r}").alias("non_null")) for r, c in hits.items()])))) if pairs else None


DECLARED = [{"name": "id", "role": "key", "level": "required", "rules": [{"kind": "not_null"}]}, {"name": "amount", "level": "required", "rules": [{"kind": "non_negative"}]},
            {"name": "absent", "level": "optional"}]


@query("schema_load", f"SELECT 'amount' AS field, 'P0' AS severity, {L('COUNT(*)')} AS violations FROM fx_dirty WHERE amount < 0")
def schema_load(spark, sf):
    return plain(C.violations(view(spark, sf, "fx_dirty"), C.load_schema(DECLARED)).select("field", "severity", "violations"))


@query("schema_diff", f"""
SELECT 'absent' AS field, 'missing' AS state, CAST(0 AS BIGINT) AS non_null UNION ALL SELECT 'cat', 'undeclared', {L('COUNT(cat)')} FROM fx_dirty UNION ALL SELECT 'lat', 'undeclared', {L('COUNT(lat)')} FROM fx_dirty""")
def schema_diff(spark, sf):
    d = view(spark, sf, "fx_dirty").select("id", "amount", "cat", "lat")
    specs = C.load_schema(DECLARED)
    counts = column_counts(d).filter(F.col("field").isin(C.unregistered_fields(d, specs))).select("field", F.lit("undeclared").alias("state"), "non_null")
    gone = spark.createDataFrame([(f, "missing", 0) for f in C.missing_fields(d, specs)], "field string, state string, non_null long")
    return plain(counts.unionByName(gone))


@query("schema_derive_assertions", f"""
SELECT 'size' AS name, CAST(1 AS BIGINT) AS passed, {R('COUNT(*)')} AS actual FROM fx_dirty
UNION ALL SELECT 'more keys than banks', CAST(1 AS BIGINT), NULL UNION ALL SELECT 'not registered', CAST(0 AS BIGINT), NULL""")
def schema_derive_assertions(spark, sf):
    config = [{"name": "size", "check": "row_count_ge", "min": 10, "severity": "P0"}, {"name": "more keys than banks", "check": "custom"}, {"name": "not registered", "check": "custom"}]
    custom = {"more keys than banks": lambda df: (df.select("id").distinct().count() > 40, "")}
    return plain(V.validate(view(spark, sf, "fx_dirty"), V.build_assertions(config, custom)).select("name", "passed", "actual"))
