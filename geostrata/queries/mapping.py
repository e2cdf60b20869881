"""Mapping operations."""

from pyspark.sql import functions as F

from geostrata.operators.mapping import MappingScheme, apply_scheme
from geostrata.queries.registry import L, R, plain, query, table, view


def _apply(df, scheme):
    return apply_scheme(df, scheme).data


@query("map_rename", f"SELECT {L('c_custkey')} AS id, c_mktsegment AS class FROM customer")
def map_rename(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return plain(_apply(d, MappingScheme().rename({"c_custkey": "id", "c_mktsegment": "class"})))


@query("map_derive_expr", f"SELECT {L('o_orderkey')} AS o_orderkey, {R('o_totalprice * 2 + 1')} AS twice FROM orders")
def map_derive_expr(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return plain(_apply(d, MappingScheme().derive("twice", "o_totalprice * 2 + 1").drop(["o_totalprice"])))


@query("map_derive_fn", f"SELECT {L('o_orderkey')} AS o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'large' ELSE 'small' END AS size FROM orders")
def map_derive_fn(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    fn = lambda df: F.when(F.col("o_totalprice") > 250000, "large").otherwise("small")
    return plain(_apply(d, MappingScheme().derive("size", fn).drop(["o_totalprice"])))


@query("map_bin", f"""
SELECT {L('p_partkey')} AS p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN 'low' WHEN p_size > 10 AND p_size <= 30 THEN 'mid'
  WHEN p_size > 30 AND p_size <= 45 THEN 'high' END AS p_size_bin FROM part""")
def map_bin(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", "p_size")
    return plain(_apply(d, MappingScheme().bin("p_size", [0, 10, 30, 45], ["low", "mid", "high"]).drop(["p_size"])))


STATUS = ("F", "O", "P")


@query("map_onehot", f"SELECT {L('o_orderkey')} AS o_orderkey, " + ", ".join(
    f"{L(f'CASE WHEN o_orderstatus = {chr(39)}{s}{chr(39)} THEN 1 ELSE 0 END')} AS o_orderstatus_{s}" for s in STATUS) + " FROM orders")
def map_onehot(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return plain(_apply(d, MappingScheme().onehot(["o_orderstatus"])))


@query("map_code", f"SELECT {L('o_orderkey')} AS o_orderkey, {L('''CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE -1 END''')} AS o_orderstatus_code FROM orders")
def map_code(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return plain(_apply(d, MappingScheme().code("o_orderstatus", {"F": 1, "O": 2}, -1).drop(["o_orderstatus"])))


@query("map_aggregate", f"""
SELECT cat, {R('SUM(amount)', 3)} AS amount, {R('AVG(lat)')} AS lat, {L('COUNT(DISTINCT entity)')} AS entity, {R('MEDIAN(year)')} AS year FROM fx_dirty WHERE cat IS NOT NULL GROUP BY cat""")
def map_aggregate(spark, sf):
    s = MappingScheme().aggregate(["cat"], {"amount": "sum", "lat": "mean", "entity": "nunique", "year": "median"})
    return plain(_apply(view(spark, sf, "fx_dirty"), s).withColumn("amount", F.round("amount", 3)))


@query("map_geocode", f"""
SELECT {L('entity')} AS entity, CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN
  CAST(CAST(FLOOR(lat / 0.01) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(FLOOR(lng / 0.01) AS BIGINT) AS VARCHAR) END AS cell FROM fx_dim""")
def map_geocode(spark, sf):
    d = view(spark, sf, "fx_dim").select("entity", "lat", "lng")
    return plain(_apply(d, MappingScheme().geocode("lat", "lng", resolution=None, size=0.01)).select("entity", "cell"))


@query("map_drop", f"SELECT {L('n_nationkey')} AS n_nationkey, n_name FROM nation")
def map_drop(spark, sf):
    return plain(_apply(table(spark, sf, "nation"), MappingScheme().drop(["n_regionkey"])))


SCHEME = [
    {"op": "rename", "mapping": {"o_totalprice": "price"}},
    {"op": "derive", "name": "net", "expr": "price * 0.9"},
    {"op": "bin", "field": "net", "bins": [0, 100000, 300000], "labels": ["low", "high"]},
    {"op": "code", "field": "o_orderstatus", "mapping": {"F": 1}, "default": 0},
    {"op": "drop", "columns": ["price", "o_orderdate", "o_orderpriority", "o_custkey"]},
]


@query("map_scheme", f"""
SELECT {L('o_orderkey')} AS o_orderkey, o_orderstatus, {R('o_totalprice * 0.9')} AS net,
  CASE WHEN o_totalprice * 0.9 > 0 AND o_totalprice * 0.9 <= 100000 THEN 'low' WHEN o_totalprice * 0.9 > 100000 AND o_totalprice * 0.9 <= 300000 THEN 'high' END AS net_bin,
  {L("CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END")} AS o_orderstatus_code FROM orders""")
def map_scheme(spark, sf):
    return plain(_apply(table(spark, sf, "orders"), MappingScheme.from_spec(SCHEME)))


@query("lineage", f"""
SELECT * FROM (VALUES ('price', 'o_totalprice', 'rename'), ('net', 'price', 'derive'), ('net_bin', 'net', 'bin'), ('o_orderstatus_code', 'o_orderstatus', 'code')) v(output, sources, op),
  (SELECT {L('COUNT(*)')} AS rows FROM orders)""")
def lineage(spark, sf):
    got = apply_scheme(table(spark, sf, "orders"), MappingScheme.from_spec(SCHEME))
    rows = got.data.agg(F.count("*").alias("rows")).withColumn("_one", F.lit(1))
    return plain(got.lineage.select("output", "sources", "op", F.lit(1).alias("_one")).join(rows, "_one").drop("_one"))
