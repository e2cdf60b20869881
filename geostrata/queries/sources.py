"""Readers, writers and discovery, each on files that Spark writes from the tables."""

import uuid
from functools import partial

from pyspark.sql import functions as F

from geostrata.operators.panel import growth
from geostrata.queries.registry import L, R, plain, query, table, view
from geostrata.session import scratch_path
from geostrata.sources import discover as D
from geostrata.sources import readers as I
from geostrata.sources import sinks as K

CUSTOMER = f"SELECT {L('c_custkey')} AS c_custkey, c_name, {R('c_acctbal')} AS c_acctbal, c_mktsegment FROM customer"


def _customer(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def _files(spark, path):
    return D.expand(spark, [path])[0]


def _round_trip(name, fmt, sql, reader):
    @query(name, sql)
    def run(spark, sf):
        path = scratch_path(spark, name)
        K.write(_customer(spark, sf), path, fmt)
        return plain(reader(spark, path).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))


_round_trip("src_csv", "csv", CUSTOMER, lambda s, p: I.read_csv(s, _files(s, p)))
_round_trip("src_dispatch", "tsv", CUSTOMER, lambda s, p: I.union_all([I.read(s, f, sep="\t") for f in _files(s, p)]))
_round_trip("src_json", "json", CUSTOMER, lambda s, p: I.read_json(s, _files(s, p)))
_round_trip("src_csv_sniff", "tsv", CUSTOMER, lambda s, p: I.read_delimited(s, _files(s, p)))
_round_trip("sink_table", "json", CUSTOMER, lambda s, p: s.read.option("multiLine", True).json(p))
_round_trip("sink_jsonl", "jsonl", CUSTOMER, lambda s, p: s.read.json(p))


@query("src_json_mixed", f"{CUSTOMER} UNION ALL {CUSTOMER}")
def src_json_mixed(spark, sf):
    """Arrays and lines in one folder listing."""
    path = scratch_path(spark, "json-forms")
    for fmt in ("json", "jsonl"):
        K.write(_customer(spark, sf), f"{path}/{fmt}", fmt)
    files = _files(spark, f"{path}/json") + _files(spark, f"{path}/jsonl")
    return plain(I.read_json(spark, files).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))


@query("sink_bom", f"SELECT {L('c_custkey')} AS c_custkey, c_name, {R('c_acctbal')} AS c_acctbal, c_mktsegment, CAST(1 AS BIGINT) AS marked FROM customer")
def sink_bom(spark, sf):
    path = scratch_path(spark, "bom")
    K.write(_customer(spark, sf), path, "csv", bom=True)
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file")).filter("left(value, 1) = '\ufeff'")
    marked = lines.agg((F.count("*") == F.countDistinct("file")).cast("long").alias("marked"))
    back = I.read_delimited(spark, _files(spark, path)).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").withColumn("one", F.lit(1))
    return plain(back.join(marked.withColumn("one", F.lit(1)), "one").drop("one"))


@query("src_broken_rows", f"""
SELECT CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS file, {L('COUNT(*)')} AS rows, {L('SUM(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END)')} AS broken FROM orders GROUP BY 1""")
def src_broken_rows(spark, sf):
    path = scratch_path(spark, "ragged")
    o = table(spark, sf, "orders")
    cells = F.concat_ws(",", "o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 14 == 0, F.lit("x,y,z")).when(F.col("o_orderkey") % 7 != 0, F.lit("x")))
    for i, name in enumerate(("even", "odd")):
        K._framed(o.filter(F.col("o_custkey") % 2 == i).select(cells.alias("value")), f"{path}/{name}", "errorifexists", "id,price,mark", None, "")
    got = I.load_sources(spark, [f"{path}/even/*.txt", f"{path}/odd/*.txt"])
    name = F.regexp_extract("path", "/(even|odd)/", 1).alias("file")
    rows = got.data.groupBy("__source_file").count()
    per = got.sources.select(name, "broken", F.element_at(F.split("path", "/"), -1).alias("__source_file")).join(rows, "__source_file", "left")
    return plain(per.groupBy("file").agg(F.sum("count").alias("rows"), F.sum("broken").alias("broken")))
_round_trip("sink_csv_table", "csv", CUSTOMER, lambda s, p: s.read.csv(p, header=True, inferSchema=True))


@query("src_csv_headerless", f"SELECT {L('o_orderkey')} AS c0, {R('o_totalprice')} AS c1, {L('o_custkey')} AS c2 FROM orders")
def src_csv_headerless(spark, sf):
    path = scratch_path(spark, "headerless")
    table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey").write.option("sep", "|").csv(path)
    return plain(I.read_delimited(spark, _files(spark, path)))


@query("src_xml", f"SELECT {L('n_nationkey')} AS id, n_name AS name, {L('n_regionkey')} AS region FROM nation")
def src_xml(spark, sf):
    path = scratch_path(spark, "xml")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("@id"), F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("region")).alias("at"))
    n.write.format("xml").option("rootTag", "nations").option("rowTag", "nation").option("attributePrefix", "@").save(path)
    got = I.read_xml(spark, path)
    return plain(got.select(F.col("`@id`").cast("long").alias("id"), F.col("`name.#text`").alias("name"), F.col("`at_region.#text`").cast("long").alias("region")))


@query("src_ntriples", """
SELECT 'http://x/c/' || c_custkey AS subject, 'http://x/segment' AS predicate, c_mktsegment AS object FROM customer
UNION SELECT 'http://x/c/' || c_custkey, 'http://x/nation', 'http://x/n/' || c_nationkey FROM customer""")
def src_ntriples(spark, sf):
    path = scratch_path(spark, "triples")
    c = table(spark, sf, "customer")
    lines = F.array(
        F.format_string('<http://x/c/%d> <http://x/segment> "%s" .', "c_custkey", "c_mktsegment"),
        F.format_string("<http://x/c/%d> <http://x/nation> <http://x/n/%d> . # nation", "c_custkey", "c_nationkey"),
        F.lit("# a comment"), F.format_string('<http://x/c/%d> <http://x/segment> "%s" .', "c_custkey", "c_mktsegment"))
    c.select(F.explode(lines)).write.text(path)
    return I.read_ntriples(spark, path)


@query("src_prune_cast", f"""
SELECT {L('o_orderkey')} AS o_orderkey, {R('o_totalprice')} AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS d, CAST(NULL AS VARCHAR) AS absent,
  {R("CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 100 END")} AS num FROM orders""")
def src_prune_cast(spark, sf):
    path = scratch_path(spark, "prune")
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderstatus", F.date_format("o_orderdate", "MM/dd/yyyy hh:mm:ss a").alias("o_orderdate"),
        F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise((F.col("o_orderkey") % 100).cast("string")).alias("num"))
    K.write(o, path, "csv")
    raw = I.read_csv(spark, _files(spark, path), infer=False)
    got = I.prune_cast(raw, {"o_orderkey": "long", "o_totalprice": "number", "o_orderdate": "date", "absent": "string", "num": "number"})
    return plain(got.withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd")).drop("o_orderdate"))


YEARS = tuple(range(1995, 2002))


def yearly(spark, sf):
    """Orders as one folder of CSV files per year; early years lack a column."""
    path = scratch_path(spark, "yearly")
    o = table(spark, sf, "orders").withColumn("yr", F.year("o_orderdate"))
    cols = ["o_orderkey", "o_custkey", "o_totalprice"]
    o.filter("yr < 1998").select(*cols, "yr").write.partitionBy("yr").option("header", True).csv(f"{path}/early")
    o.filter("yr >= 1998").select(*cols, "o_orderpriority", "yr").write.partitionBy("yr").option("header", True).csv(f"{path}/late")
    return path


YEARLY = f"SELECT {L('o_orderkey')} AS o_orderkey, {R('o_totalprice')} AS o_totalprice, CASE WHEN year(o_orderdate) >= 1998 THEN o_orderpriority END AS o_orderpriority FROM orders"


@query("src_group_union", YEARLY)
def src_group_union(spark, sf):
    catalog = D.scan(spark, yearly(spark, sf)).withColumn("group", F.lit("orders_#"))
    return plain(I.read_group(spark, catalog, "orders_#").select("o_orderkey", "o_totalprice", "o_orderpriority"))


@query("src_multi_union", f"SELECT {L('COUNT(*)')} AS rows, {L('COUNT(CASE WHEN year(o_orderdate) >= 1998 THEN o_orderpriority END)')} AS with_priority, {L('COUNT(*)')} AS with_source FROM orders")
def src_multi_union(spark, sf):
    b = I.load_sources(spark, [yearly(spark, sf)])
    return plain(b.data.agg(F.count("*").alias("rows"), F.count("o_orderpriority").alias("with_priority"), F.count(I.SOURCE_FILE).alias("with_source")))


@query("src_expand", f"SELECT {L('COUNT(DISTINCT year(o_orderdate))')} AS folders, {L('COUNT(*)')} AS rows FROM orders")
def src_expand(spark, sf):
    files, _ = D.expand(spark, [yearly(spark, sf)])
    folders = len({f.rsplit("/", 2)[-2] for f in files})
    return plain(D.text_facts(spark, files).agg(F.lit(folders).alias("folders"), F.sum(F.col("lines") - 1).alias("rows")))


@query("src_points", f"SELECT {R('lat')} AS lat, {R('lng')} AS lon, {R('CASE WHEN acq_year IS NOT NULL THEN 1 ELSE 0 END')} AS value FROM fx_dim")
def src_points(spark, sf):
    d = view(spark, sf, "fx_panel").select("entity", "year").join(view(spark, sf, "fx_dim").select("entity", "lat", "lng", "acq_year"), "entity")
    return plain(I.entity_points(d, "entity", "year", "acq_year", "lat", "lng"))


@query("src_day_sample", f"SELECT {L('COUNT(*)')} AS rows, {R('SUM(value)', 3)} AS total FROM events WHERE day(ts) = 15")
def src_day_sample(spark, sf):
    path = scratch_path(spark, "days")
    e = table(spark, sf, "events").select("event_id", "value", F.date_format("ts", "yyyyMMdd").alias("day"))
    e.write.partitionBy("day").option("header", True).csv(path)
    files = _files(spark, path)
    folder = {f.rsplit("/", 2)[-2]: [] for f in files}
    for f in files:
        folder[f.rsplit("/", 2)[-2]].append(f)
    kept = [f for d in D.with_day(sorted(folder), "15") for f in folder[d]]
    got = I.read_csv(spark, kept)
    return plain(got.agg(F.count("*").alias("rows"), F.sum("value").alias("total")), 3)


@query("src_parquet_cache", CUSTOMER)
def src_parquet_cache(spark, sf):
    path = scratch_path(spark, "stage")
    build = partial(_customer, spark, sf)
    I.cached_stage(spark, path, build)
    return plain(I.cached_stage(spark, path, lambda: build().limit(0)))


@query("sink_parquet", f"SELECT {L('o_orderkey')} AS o_orderkey, {R('o_totalprice')} AS o_totalprice, {L('year(o_orderdate)')} AS yr FROM orders")
def sink_parquet(spark, sf):
    path = scratch_path(spark, "parquet")
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("yr"))
    K.write(o, path, "parquet", ["yr"])
    return plain(spark.read.parquet(path))


@query("sink_bucketed", f"""SELECT {L('entity')} AS entity, {L('year')} AS year, {R('value - LAG(value) OVER (PARTITION BY entity ORDER BY year)')} AS chg FROM fx_panel""")
def sink_bucketed(spark, sf):
    stored = K.write_bucketed(view(spark, sf, "fx_panel"), "panel_by_entity_" + uuid.uuid4().hex[:8], scratch_path(spark, "bucketed"), "entity", ["year"], 16)
    return plain(growth(stored, "value", "entity", "year").select("entity", "year", "chg"))


@query("sink_report", f"SELECT 'cat' AS field, {L('COUNT(*) - COUNT(cat)')} AS null_count FROM fx_dirty UNION ALL SELECT 'amount', {L('COUNT(*) - COUNT(amount)')} FROM fx_dirty")
def sink_report(spark, sf):
    from geostrata.operators.profile import null_table

    path = scratch_path(spark, "report")
    K.write_report({"nulls": null_table(view(spark, sf, "fx_dirty").select("cat", "amount"))}, path)
    return plain(spark.read.option("multiLine", True).json(f"{path}/nulls").select("field", "null_count"))


# --- discovery ---------------------------------------------------------------------------------


def _listing(spark, sf):
    path = yearly(spark, sf)
    files = D.scan(spark, path)
    facts = D.peek_columns(D.text_facts(spark, [r["path"] for r in files.select("path").collect()]))
    key = lambda c: F.regexp_replace(c, "^file:/*", "/")
    year = F.regexp_extract("parent", r"yr=(\d+)", 1)
    return files.withColumn("k", key(F.col("path"))).join(facts.select(key(F.col("path")).alias("k"), "lines", "columns"), "k").withColumns(
        {"year": year, "group": F.regexp_replace("parent", r"\d+", "#")})


@query("disc_scan", f"SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS year, 'csv' AS format FROM orders")
def disc_scan(spark, sf):
    files = D.scan(spark, yearly(spark, sf), ["csv"])
    return files.select(F.regexp_extract("parent", r"yr=(\d+)", 1).alias("year"), "format").distinct()


@query("disc_line_count", f"SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, {L('COUNT(*)')} AS data_lines FROM orders GROUP BY 1")
def disc_line_count(spark, sf):
    return plain(_listing(spark, sf).groupBy("year").agg(F.sum(F.col("lines") - 1).alias("data_lines")))


@query("disc_peek_columns", """SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS year,
  CASE WHEN year(o_orderdate) < 1998 THEN 'o_orderkey,o_custkey,o_totalprice' ELSE 'o_orderkey,o_custkey,o_totalprice,o_orderpriority' END AS columns FROM orders""")
def disc_peek_columns(spark, sf):
    heads = D.peek_columns(D.first_lines(spark, _files(spark, yearly(spark, sf))))
    return heads.select(F.regexp_extract("path", r"yr=(\d+)", 1).alias("year"), F.array_join("columns", ",").alias("columns")).distinct()


@query("disc_group", r"SELECT regexp_replace(regexp_replace(regexp_replace(c_name || '_' || (c_custkey % 7) || '.csv.gz', '\.gz$', ''), '\.csv$', ''), '\d+', '#', 'g') AS grp, CAST(COUNT(*) AS BIGINT) AS n FROM customer GROUP BY 1")
def disc_group(spark, sf):
    name = F.concat("c_name", F.lit("_"), (F.col("c_custkey") % 7).cast("string"), F.lit(".csv.gz"))
    return plain(table(spark, sf, "customer").groupBy(D.group_name(name).alias("grp")).agg(F.count("*").alias("n")))


def _as_listing(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("parent"), F.col("lang").alias("format"), F.col("n_chars").alias("size"))


def _dist(name, by, col):
    @query(name, f"""SELECT {col} AS {by}, {L('COUNT(*)')} AS files, {L('SUM(n_chars)')} AS bytes, {R('SUM(n_chars) * 1.0 / (SELECT SUM(n_chars) FROM documents)')} AS share,
      STRING_AGG(DISTINCT lang, ',' ORDER BY lang) AS formats FROM documents GROUP BY 1""")
    def run(spark, sf):
        return plain(D.distribution(_as_listing(spark, sf), by))


_dist("disc_format_dist", "format", "lang")
_dist("disc_dir_dist", "parent", "source")


@query("disc_group_summary", f"SELECT 'yr=#' AS grp, 'csv' AS formats, {L('COUNT(*)')} AS data_lines, 'o_custkey,o_orderkey,o_orderpriority,o_totalprice' AS columns FROM orders")
def disc_group_summary(spark, sf):
    files = _listing(spark, sf).withColumn("lines", F.col("lines") - 1)
    g = D.group_summary(files)
    return plain(g.select(F.col("group").alias("grp"), F.array_join("formats", ",").alias("formats"), F.col("lines").alias("data_lines"), F.array_join("columns", ",").alias("columns")))


@query("disc_drift", f"""SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS year, CASE WHEN year(o_orderdate) >= 1998 THEN 'o_orderpriority' ELSE '' END AS added, '' AS missing,
  CAST(CASE WHEN year(o_orderdate) >= 1998 THEN 0 ELSE 1 END AS BIGINT) AS consistent FROM orders""")
def disc_drift(spark, sf):
    d = D.drift(_listing(spark, sf))
    return plain(d.select(F.regexp_extract("path", r"yr=(\d+)", 1).alias("year"), F.array_join("added", ",").alias("added"), F.array_join("missing", ",").alias("missing"), "consistent").distinct())


@query("disc_schema_coverage", f"""SELECT 'o_orderpriority' AS "column", {L('COUNT(DISTINCT CASE WHEN year(o_orderdate) >= 1998 THEN year(o_orderdate) END)')} AS in_files, {L('COUNT(DISTINCT year(o_orderdate))')} AS of_files FROM orders""")
def disc_schema_coverage(spark, sf):
    files = _listing(spark, sf).groupBy(F.col("parent").alias("path")).agg(F.first("columns").alias("columns"))
    return plain(D.schema_coverage(files))


def _lines_by_year(spark, sf):
    """One file per year, its lines in order, so that its bytes are known."""
    path = scratch_path(spark, "lines")
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("yr"), "o_orderkey", F.concat_ws(",", "o_orderkey", "o_custkey").alias("value"))
    o.repartition(1).sortWithinPartitions("yr", "o_orderkey").select("yr", "value").write.partitionBy("yr").text(path)
    return _files(spark, path)


_BYTES = "WITH b AS (SELECT year(o_orderdate) AS year, string_agg(o_orderkey || ',' || o_custkey || chr(10), '' ORDER BY o_orderkey) AS t FROM orders GROUP BY 1)"


@query("disc_fingerprint", f"{_BYTES} SELECT {L('year')} AS year, {L('length(t)')} AS size, md5(t) AS digest FROM b")
def disc_fingerprint(spark, sf):
    f = D.fingerprints(spark, _lines_by_year(spark, sf))
    return plain(f.select(F.regexp_extract("path", r"yr=(\d+)", 1).cast("long").alias("year"), "size", "digest"))


@query("disc_fingerprint_blocks", f"""{_BYTES}, p AS (SELECT year, i, md5(substr(t, CAST(i * 10000 + 1 AS BIGINT), 10000)) AS d FROM b, (SELECT UNNEST(RANGE(0, 10000)) AS i) WHERE i * 10000 < length(t))
SELECT {L('year')} AS year, md5(string_agg(d, '' ORDER BY i)) AS digest FROM p GROUP BY year""")
def disc_fingerprint_blocks(spark, sf):
    f = D.fingerprints(spark, _lines_by_year(spark, sf), block_bytes=10_000)
    return plain(f.select(F.regexp_extract("path", r"yr=(\d+)", 1).cast("long").alias("year"), "digest"))

