import gzip
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geostrata.operators.infer import SOURCE_FILE, detect_shape, infer_mapping
from geostrata.plans import jobs as J
from geostrata.sources import discover as D
from geostrata.sources import readers as I
from geostrata.sources import sinks as K
from geostrata.sources.formats import UnsupportedFormat, detect_format


def test_formats():
    assert detect_format("a/b.csv.gz") == "csv" and detect_format("x.XLS") == "xlsx" and detect_format("p.ndjson") == "jsonl"
    with pytest.raises(UnsupportedFormat):
        detect_format("readme.log")


@pytest.mark.parametrize("encoding,name", [("utf-8-sig", "utf-8"), ("utf-8", "utf-8"), ("gb18030", "gb18030"), ("latin-1", "latin-1")])
def test_csv_encodings(spark, tmp_path, encoding, name):
    text = "caf\u00e9\u00df" if encoding == "latin-1" else "\u7f51\u70b9"
    body = f"id,name\n1,plain\n2,{text}\n"
    if encoding == "latin-1":
        body = "id,name\n1,plain\n2,caf\u00e9\n"
        text = "caf\u00e9"
    p = tmp_path / "f.csv"
    p.write_bytes(body.encode(encoding))
    assert I.detect_encoding(spark, str(p)) == name
    got = I.read_csv(spark, str(p)).orderBy("id").collect()
    assert [(r["id"], r["name"]) for r in got] == [(1, "plain"), (2, text)]


def test_json_forms(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\n{"a":2}\n')
    (tmp_path / "b.json").write_text('[{"a":1},\n {"a":2}]')
    for n in ("a.jsonl", "b.json"):
        assert sorted(r["a"] for r in I.read(spark, str(tmp_path / n)).collect()) == [1, 2]


def test_xml(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<root><head/><item name="x" val="1"><sub k="q">t</sub><p><q>1</q></p><p><q>2</q></p></item><item name="y" val="2"/></root>')
    assert I.record_tag(spark, str(tmp_path / "r.xml")) == "item"
    rows = I.read_xml(spark, str(tmp_path / "r.xml")).orderBy("@name").collect()
    assert len(rows) == 2 and rows[0]["@name"] == "x" and rows[0]["sub.#text"] == "t" and rows[0]["sub.@k"] == "q" and rows[0]["p_q.#text"] == "2"


def test_ntriples(spark, tmp_path):
    (tmp_path / "g.nt").write_text('# c\n<http://a> <http://p> "x \\"y\\""@en .\n<http://a> <http://p> "x \\"y\\""@en .\n_:b <http://p> <http://c> . # tail\n\n')
    rows = sorted(tuple(r) for r in I.read(spark, str(tmp_path / "g.nt")).collect())
    assert rows == [("_:b", "http://p", "http://c"), ("http://a", "http://p", 'x \\"y\\"')]


def test_xlsx(spark, tmp_path):
    sheet = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
    <row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>c</t></is></c></row>
    <row r="2"><c r="A2"><v>5</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"><c r="C3"><v>7</v></c></row></sheetData></worksheet>"""
    shared = """<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>id</t></si><si><r><t>he</t></r><r><t>y</t></r></si></sst>"""
    for n in ("a.xlsx", "b.xlsx"):
        with zipfile.ZipFile(tmp_path / n, "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", sheet)
            z.writestr("xl/sharedStrings.xml", shared)
    got = I.read_xlsx(spark, [str(tmp_path / "a.xlsx"), str(tmp_path / "b.xlsx")])
    assert got.columns == ["id", "c1", "c"] and got.count() == 4
    assert {(r["id"], r["c"]) for r in got.collect()} == {("5", "hey"), (None, "7")}


def test_headerless_and_union(spark, tmp_path):
    body = "0\t2010-10-19T23:55:27Z\t30.23\t-97.79\t22847\n0\t2010-10-18T22:17:43Z\t30.26\t-97.76\t420315\n"
    with gzip.open(tmp_path / "checkins.txt.gz", "wt") as f:
        f.write(body)
    got = I.read_delimited(spark, str(tmp_path / "checkins.txt.gz"))
    assert got.columns == ["c0", "c1", "c2", "c3", "c4"] and got.count() == 2
    multi = tmp_path / "multi"
    multi.mkdir()
    (multi / "one.csv").write_text("id,year,v\n1,2000,5\n2,2001,6\n")
    (multi / "two.csv").write_text("id;year;extra\n3;2002;x\n")
    b = I.load_sources(spark, [str(multi)])
    assert b.data.count() == 3 and set(b.data.columns) == {"id", "year", "v", "extra", SOURCE_FILE}
    assert {r[0] for r in b.data.select(SOURCE_FILE).distinct().collect()} == {"one.csv", "two.csv"}
    cov = D.schema_coverage(D.peek_columns(D.text_facts(spark, [str(multi)])))
    assert {(r["column"], r["in_files"], r["of_files"]) for r in cov.collect()} == {("v", 1, 2), ("extra", 1, 2)}
    with pytest.raises(FileNotFoundError):
        I.load_sources(spark, [str(tmp_path / "absent")])


def test_broken_file_is_recorded(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("id,v\n1,2\n")
    (tmp_path / "bad.xlsx").write_bytes(b"not a zip")
    b = I.load_sources(spark, [str(tmp_path)])
    assert {r["path"].rsplit("/", 1)[-1]: r["ok"] for r in b.sources.collect()} == {"ok.csv": True, "bad.xlsx": False}
    assert b.data.count() == 1 and b.notes


def test_discovery(spark, tmp_path):
    for y in (1994, 1995):
        (tmp_path / f"sod_{y}.csv").write_text(f"BRNUM,CERT{',X' if y == 1995 else ''}\n1,2{',3' if y == 1995 else ''}\n")
    for d in ("20200101", "20200115"):
        (tmp_path / f"bike_{d}_p00001.csv").write_text("a,b\n1,2\n3,4\n")
    (tmp_path / "_state.json").write_text("{}")
    (tmp_path / "readme.log").write_text("x")
    files = D.scan(spark, str(tmp_path))
    rows = files.collect()
    assert len(rows) == 4 and {r["group"] for r in rows} == {"sod_#", "bike_#_p#"}
    facts = D.peek_columns(D.text_facts(spark, [r["path"] for r in rows]))
    assert {r["lines"] for r in facts.collect()} == {2, 3}
    key = F.element_at(F.split("path", "/"), -1)
    full = files.withColumn("f", key).join(facts.select(key.alias("f"), "lines", "columns"), "f")
    d = {r["path"].rsplit("/", 1)[-1]: r for r in D.drift(full).collect()}
    assert d["sod_1995.csv"]["added"] == ["X"] and d["sod_1994.csv"]["consistent"] and d["bike_20200115_p00001.csv"]["consistent"]
    assert D.with_day([r["path"] for r in rows], "15") == [r["path"] for r in rows if "20200115" in r["path"]]
    prints = D.fingerprints(spark, [str(tmp_path / "sod_1994.csv"), str(tmp_path / "sod_1995.csv")], max_bytes=16).collect()
    assert sum(r["digest"] is None for r in prints) == 1
    listed, notes = D.expand(spark, [str(tmp_path), str(tmp_path / "*.csv"), str(tmp_path / "none.csv")], limit=3)
    assert len(listed) == 3 and len(notes) == 2


def test_group_read_and_cache(spark, tmp_path):
    for y in (1, 2, 3):
        (tmp_path / f"g_{y}.csv").write_text(f"BRNUM,DEP\n{y},{y}0\n{y + 5},{y}1\n")
    got = I.read_group(spark, D.scan(spark, str(tmp_path)), "g_#")
    assert got.count() == 6 and I.read_group(spark, D.scan(spark, str(tmp_path)), "g_#", max_files=2).count() == 4
    stage = str(tmp_path / "stage")
    assert I.cached_stage(spark, stage, lambda: got).count() == 6
    assert I.cached_stage(spark, stage, lambda: got.limit(1)).count() == 6
    with pytest.raises(UnsupportedFormat):
        K.write(got, str(tmp_path / "o"), "xml")


# --- inference ---------------------------------------------------------------------------------


def unnamed_panel(n=60, years=10):
    rng = np.random.default_rng(3)
    e, y = np.meshgrid(np.arange(n), np.arange(2000, 2000 + years), indexing="ij")
    lat, lng = 20 + rng.random(n) * 3, 100 + rng.random(n) * 8
    return pd.DataFrame({"k1": [f"E{v:03d}" for v in e.ravel()], "k2": y.ravel(), "k3": lat[e.ravel()], "k4": lng[e.ravel()], "k5": rng.lognormal(8, 1, n * years)})


def roles_of(df):
    got = infer_mapping(df)
    return {r: got[r] for r in ("entity", "time", "event_time", "lat", "lon", "value", "group")}


def test_roles_without_names(spark):
    r = roles_of(spark.createDataFrame(unnamed_panel()))
    assert (r["entity"], r["time"], r["lat"], r["lon"], r["value"]) == ("k1", "k2", "k3", "k4", "k5")


def test_integer_code_is_not_a_latitude(spark):
    rng = np.random.default_rng(1)
    d = pd.DataFrame({"code": rng.integers(1, 30, 500), "y": 30 + rng.random(500), "x": 100 + rng.random(500) * 2})
    r = roles_of(spark.createDataFrame(d))
    assert r["lat"] == "y" and r["lon"] == "x"


def test_shapes(spark):
    panel = spark.createDataFrame(unnamed_panel())
    assert detect_shape(panel, roles_of(panel))["kind"] == "panel"
    rng = np.random.default_rng(2)
    log = pd.DataFrame({"user_id": [f"u{v}" for v in rng.integers(0, 80, 600)], "event_time": pd.date_range("2020-01-01", periods=600, freq="h").astype(str), "amount": rng.random(600)})
    df = spark.createDataFrame(log)
    assert detect_shape(df, roles_of(df))["kind"] == "event_log"
    edges = spark.createDataFrame(pd.DataFrame({"src": [f"n{v}" for v in rng.integers(0, 200, 600)], "dst": [f"n{v}" for v in rng.integers(0, 200, 600)]}))
    assert detect_shape(edges, roles_of(edges))["kind"] == "network"
    twice = panel.unionByName(panel.limit(5))
    assert detect_shape(twice, {"entity": "k1", "time": "k2"})["dup_entity_time"] == 5


# --- jobs --------------------------------------------------------------------------------------


def test_workflow_on_files(spark, tmp_path):
    from geostrata.operators.clean import CleanPlan
    from geostrata.operators.mapping import MappingScheme

    for y in (1994, 1995, 1996):
        (tmp_path / f"s_{y}.csv").write_text("BRNUM,CERT,DEPSUMBR\n1,10,100\n2,20,200\n")
    df = I.read_group(spark, D.scan(spark, str(tmp_path)), "s_#").withColumn("row", F.monotonically_increasing_id())
    got = J.run_workflow(df, "row", plan=CleanPlan().drop_na(["BRNUM"]), assertions=[{"name": "n", "check": "no_negative", "field": "DEPSUMBR"}],
                         scheme=MappingScheme().derive("k", "DEPSUMBR / 1000"), order_by=["row"])
    assert got.mapped.data.count() == 6 and got.report.first()["passed"] and got.compared.count() == 4


def test_analyze_with_override(spark, tmp_path):
    unnamed_panel(30, 6).to_csv(tmp_path / "p.csv", index=False)
    got = J.run_analyze(spark, [str(tmp_path)], {"group": None, "value": "k5"})
    assert got["roles"]["entity"] == "k1" and got["shape"]["kind"] == "panel"
    assert {r["key"] for r in got["health"].collect()} >= {"scale", "geo", "span", "key", "panel", "outcome"}


def test_refit_reports_what_is_missing(spark):
    d = spark.createDataFrame(unnamed_panel(40, 8)).withColumn("mark", F.when((F.col("k2") >= 2004) & F.col("k1").endswith("5"), 1).otherwise(0))
    got = J.run_refit(d, {"entity": "k1", "time": "k2", "value": "k5"}, mark="mark")
    assert got["capabilities"] == {"panel": True, "twfe": True, "event_study": True, "support": True, "spatial": False, "risk": False}
    assert len(got["notes"]) == 2 and got["twfe"].terms == ["post"]
    assert J.run_refit(d, {"entity": "k1"})["capabilities"]["panel"] is False


def test_first_blocks_read_no_more_than_a_block(spark, tmp_path):
    from geostrata.sources.first_block import first_blocks

    (tmp_path / "long.csv").write_text("a;b\n" + "1;2\n" * 200_000)
    (tmp_path / "wide.csv").write_text("x" * 200_000 + ",y\n1,2\n")
    (tmp_path / "short.csv").write_text("﻿p\tq\n1\t2")
    files = [str(p) for p in sorted(tmp_path.iterdir())]
    got = {r.path.rsplit("/", 1)[-1]: r for r in first_blocks(spark, files, 1000).collect()}
    assert {n: (r.read, r.whole) for n, r in got.items()} == {"long.csv": (1000, False), "wide.csv": (1000, False), "short.csv": (10, True)}
    heads = {r.path.rsplit("/", 1)[-1]: (r.sep, len(r.columns)) for r in D.peek_columns(D.first_lines(spark, files)).collect()}
    assert heads == {"long.csv": (";", 2), "wide.csv": (",", 2), "short.csv": ("\t", 2)}


def test_ragged_rows_are_counted_with_an_example(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3\n4,5,6\n7,8\n")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    rows = {r.path.rsplit("/", 1)[-1]: (r.broken, r.example) for r in I.load_sources(spark, [str(tmp_path)]).sources.collect()}
    assert rows == {"a.csv": (2, "3"), "b.csv": (0, None)}


def test_json_forms_are_told_apart_by_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": 1},\n {"k": 2}]')
    (tmp_path / "b.json").write_text('\n\n{"k": 3}\n{"k": 4}\n')
    assert sorted(r.k for r in I.read_json(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")]).collect()) == [1, 2, 3, 4]


def test_written_arrays_marks_and_buckets(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', None), (2, None, 2.5)], "k long, t string, v double").repartition(3)
    K.write(df, str(tmp_path / "j"), "json")
    import json

    assert sorted(r["k"] for p in (tmp_path / "j").glob("part-*") for r in json.loads(p.read_text())) == [1, 2]
    K.write(df, str(tmp_path / "c"), "csv", bom=True)
    assert all(p.read_text().startswith("﻿k,t,v\n") for p in (tmp_path / "c").glob("part-*"))
    back = I.read_csv(spark, str(tmp_path / "c"), sep=",")
    assert sorted(map(tuple, back.select(F.col(back.columns[1]).alias("t"), "v").collect()), key=str) == sorted([('a "q", b', None), (None, 2.5)], key=str)
    from geostrata.operators.panel import growth

    p = spark.createDataFrame([(e, t, float(e * t)) for e in range(9) for t in range(4)], "e long, t long, v double")
    stored = K.write_bucketed(p, "bucketed_for_a_test", str(tmp_path / "b"), "e", ["t"], 4)
    plan = growth(stored, "v", "e", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan
    assert sorted(map(tuple, growth(stored, "v", "e", "t").collect()), key=str) == sorted(map(tuple, growth(p, "v", "e", "t").collect()), key=str)
    spark.sql("DROP TABLE bucketed_for_a_test")


def test_stored_profiles_grow_by_new_sources_only(spark, tmp_path):
    import numpy as np

    from geostrata.operators import sketches as S

    rng = np.random.default_rng(1)
    rows = [(f"s{i % 4}", float(x), int(x * 10) % 3000) for i, x in enumerate(rng.lognormal(3, 1, 40_000))]
    df, seen = spark.createDataFrame(rows, "src string, v double, k int"), []

    def read(names):
        seen.append(names)
        return df.filter(F.col("src").isin(names))

    store = str(tmp_path / "store")
    assert S.update(spark, store, ["s0", "s1"], read, "src") == ["s0", "s1"]
    assert S.update(spark, store, ["s0", "s1", "s2", "s3"], read, "src") == ["s2", "s3"]
    assert S.update(spark, store, ["s3"], read, "src") == [] and seen == [["s0", "s1"], ["s2", "s3"]]
    got = {r.field: r for r in S.summary(S.merged(S.stored(spark, store)), (0.25, 0.5, 0.99)).collect()}
    v = np.array([r[1] for r in rows])
    assert got["v"].rows == len(v) and got["v"].mean == pytest.approx(v.mean()) and got["v"].std == pytest.approx(v.std())
    for q, name in ((0.25, "q25"), (0.5, "q50"), (0.99, "q99")):
        assert abs((v <= got["v"][name]).mean() - q) < 0.02
    assert abs(got["k"].distinct / len({r[2] for r in rows}) - 1) < 0.05


def test_equal_buckets_are_not_joined(spark):
    from geostrata.operators import validate as V

    a = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    b = a.withColumn("v", F.when(F.col("k") == 77, 100.0).when(F.col("k") != 78, F.col("v"))).filter("k <> 79").union(spark.sql("SELECT CAST(NULL AS long), 1D"))
    tree, whole = (V.reconcile(a, b, ["k"], ["v"], unique_keys=u).first() for u in (True, False))
    assert tree == whole and (tree.rows_left, tree.rows_right, tree.rows_both, tree.null_mismatch, tree.max_diff) == (5000, 5000, 4999, 1, 100.0)
    assert V.reconcile(a, a, ["k"], ["v"]).first().ok


def test_a_file_above_two_gigabytes_has_a_digest(spark, tmp_path):
    import hashlib

    big, block = tmp_path / "big.csv", 1 << 29
    with open(big, "wb") as f:
        f.truncate(3 * (1 << 30) - 7)  # sparse
        f.seek(1 << 31)
        f.write(b"mark")
    got = D.fingerprints(spark, [str(big)], block_bytes=block).first()
    zeros, parts = hashlib.md5(bytes(block)).hexdigest(), []
    for start in range(0, got["size"], block):
        data = bytearray(min(block, got["size"] - start))
        if start == 1 << 31:
            data[:4] = b"mark"
        parts.append(zeros if len(data) == block and start != 1 << 31 else hashlib.md5(data).hexdigest())
    assert got["digest"] == hashlib.md5("".join(parts).encode()).hexdigest()


def test_refit_computes_its_input_twice_at_most(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(e, 1990 + t, float(100 + (e * 7 + t * 13) % 50 + t * e % 3), int((e * 5 + t) % 7 == 0), 40 + e % 9 / 10 + e / 1e4, -90 + e // 9 / 10, float(e * t % 11), "ab"[e % 2])
            for e in range(40) for t in range(6)]
    schema = "entity long, year long, value double, mark int, lat double, lng double, size double, grp string"
    d = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    roles = {"entity": "entity", "time": "year", "value": "value", "lat": "lat", "lon": "lng", "group": "grp"}
    got = J.run_refit(d, roles, mark="mark", exit_col="mark")
    assert got["notes"] == [] and all(got["capabilities"].values())
    assert seen.value == 2 * len(rows)  # once for the panel, once for the risk model
