from datetime import datetime

import pytest
from pyspark.sql import functions as F

from geostrata.operators import clean as C
from geostrata.operators import profile as P
from geostrata.operators import validate as V
from geostrata.operators.mapping import MappingScheme, aggregate, apply_scheme
from geostrata.operators.schema import (
    FieldSpec,
    Rule,
    detect_columns,
    infer_roles,
    list_templates,
    load_schema,
    missing_fields,
    save_template,
    schema_roles,
    tag_roles,
    unregistered_fields,
    violations,
)


@pytest.fixture(scope="module")
def five(spark):
    rows = [(1.0, 10.0, "a"), (2.0, None, "b"), (None, 30.0, "a"), (4.0, 1000.0, None), (5.0, 40.0, "b")]
    return spark.createDataFrame(rows, "id double, amount double, cat string")


def values(df, c):
    return [r[c] for r in df.orderBy("id").collect()]


def test_drop_and_fill(five):
    got = C.clean(five, C.CleanPlan().drop_na(["id"]).fill("amount", "median"), ["id"])
    assert got.data.count() == 4
    assert got.data.filter("amount is null").count() == 0
    log = {r["step"]: (r["action"], r["affected_rows"], r["reversible"]) for r in got.log.collect()}
    assert log == {1: ("drop_na", 1, False), 2: ("fill", 1, True)}
    assert got.stats.first().asDict() == {"before_rows": 5, "after_rows": 4, "removed_rows": 1}


def test_empty_subset_means_all_columns(five):
    assert C.clean(five, C.CleanPlan().drop_na(), ["id"]).data.count() == 2


def test_mode_prefers_the_smaller_value(five):
    assert values(C.fill(five.filter("id is not null"), "cat", "mode"), "cat") == ["a", "b", "b", "b"]
    tie = five.filter("id in (1, 2, 4)")
    assert values(C.fill(tie, "cat", "mode"), "cat") == ["a", "b", "a"]


def test_dedup_keeps_the_asked_row(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 9, 1), (2, 2, 2), (None, 3, 3), (None, 4, 4)], "id long, v long, o long")
    assert sorted(r["v"] for r in C.deduplicate(df, ["id"], ["o"]).collect()) == [1, 2, 3]
    assert sorted(r["v"] for r in C.deduplicate(df, ["id"], ["o"], "last").collect()) == [2, 4, 9]


def test_winsorize_and_clip(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 100.0), (5, None)], "id long, x double")
    assert max(v for v in values(C.winsorize(df, "x", 0.25), "x") if v is not None) == pytest.approx(27.25)
    assert values(C.clip(df, "x", 2.0, None), "x") == [2.0, 2.0, 3.0, 100.0, None]
    assert values(C.clip(df, "x", None, 50.0, "to_null"), "x") == [1.0, 2.0, 3.0, None, None]


def test_repeated_steps_keep_their_own_counts(spark):
    df = spark.createDataFrame([(1, -5.0), (2, 7.0), (3, None)], "id long, x double")
    plan = C.CleanPlan().clip("x", 0.0).fill("x", "constant", 1.0).clip("x", 1.0).filter("x < 5").drop_duplicates(["x"])
    got = C.clean(df, plan, ["id"])
    assert [(r["action"], r["affected_rows"]) for r in got.log.orderBy("step").collect()] == [
        ("clip", 1), ("fill", 1), ("clip", 1), ("filter", 1), ("drop_duplicates", 1)]
    assert got.data.columns == ["id", "x"] and got.data.count() == 1


def test_plan_from_config():
    with pytest.raises(ValueError, match="unknown clean op"):
        C.CleanPlan.from_spec([{"op": "filter", "predicate": "x > 0"}])
    with pytest.raises(ValueError, match="unknown clean op"):
        C.CleanPlan.from_spec([{"op": "nope"}])
    with pytest.raises(ValueError, match="incomplete"):
        C.CleanPlan.from_spec([{"op": "astype", "field": "x"}])
    with pytest.raises(ValueError, match="order_by"):
        C.fill(None, "x", "ffill")


def test_astype_fails_loudly(spark):
    df = spark.createDataFrame([("a",)], "x string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        C.clean(df, C.CleanPlan().astype("x", "int")).data.collect()


def test_outlier_only_in_amount(five):
    for method, t in (("iqr", 1.5), ("zscore", 1.5), ("mad", 3.5)):
        got = P.outliers(five.withColumn("row", F.monotonically_increasing_id()), "row", method, t, ["id", "amount"])
        assert [(r["field"], r["value"]) for r in got.collect()] == [("amount", 1000.0)]
    with pytest.raises(ValueError):
        P.outliers(five, "id", "other")
    flat = five.withColumn("amount", F.lit(1.0))
    assert P.outliers(flat, "id", "zscore", 1.0, ["amount"]).count() == 0


def test_profile_object(five):
    p = P.profile(five.withColumn("row", F.monotonically_increasing_id()), "row", {"cat": "categorical"})
    s = p.summary.first()
    assert (s["rows"], s["columns"], s["null_cells"], s["outlier_count"]) == (5, 4, 3, 1)
    assert {r["field"]: r["distinct"] for r in p.fields.collect()}["cat"] == 2
    approx = {r["field"]: r["median"] for r in P.numeric_stats(five, ["amount"], approx=True).collect()}
    assert approx["amount"] in (30.0, 40.0)


def test_validate(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, -5.0, "b"), (3, 7.0, "a")], "id long, amount double, cat string")

    def broken(_):
        raise RuntimeError("boom")

    got = {r["name"]: r for r in V.validate(df, [
        {"name": "u", "check": "unique", "field": "id"}, {"name": "n", "check": "no_negative", "field": "amount", "severity": "P0"},
        {"name": "one-sided", "check": "range", "field": "amount", "max": 6}, {"name": "info", "check": "row_count_ge", "min": 9, "info": True}, broken,
    ]).collect()}
    assert got["u"]["passed"] and not got["n"]["passed"] and got["n"]["actual"] == 1
    assert got["one-sided"]["actual"] == 1 and got["info"]["status"] == "info"
    assert got["broken"]["status"] == "fail" and got["broken"]["message"] == "boom"
    empty = V.validate(df.limit(0), [{"check": "null_rate_le", "field": "id", "max": 0.0}]).first()
    assert empty["passed"] and empty["actual"] == 0.0
    s = V.report_summary(V.validate(df, [{"check": "no_negative", "field": "amount", "severity": "P0"}])).first()
    assert s["blocking"] and s["failed_p0"] == 1


def test_unregistered_custom_check_fails(spark):
    df = spark.createDataFrame([(1,)], "id long")
    rows = V.validate(df, V.build_assertions([{"name": "x", "check": "custom"}])).collect()
    assert rows[0]["status"] == "fail"


def test_null_key_after_cleaning_means_redo(spark):
    df = spark.createDataFrame([(1, 1.0), (None, 2.0)], "k long, v double")
    nulls, outs = P.null_table(df), P.outliers(df.withColumn("r", F.lit(1)), "r", columns=["v"])
    compared = V.compare_profiles(nulls, nulls, outs, outs)
    assert V.advice(compared, 0.0, key_fields=["k"]) == "redo" and V.advice(compared, 0.01) == "continue" and V.advice(compared, 0.2) == "redo"


def test_reconcile_verdict(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "k long, v double")
    same = V.reconcile(a, a, ["k"], ["v"]).first()
    assert same["ok"] and same["null_mismatch"] == 0
    off = V.reconcile(a, a.fillna(3.0), ["k"], ["v"]).first()
    assert not off["ok"] and off["null_mismatch"] == 1
    near = V.reconcile(a, a.withColumn("v", F.col("v") * 1.0001), ["k"], ["v"], 1e-3, relative=True).first()
    assert near["ok"]


def test_mapping(spark):
    df = spark.createDataFrame([(22.5, 113.9, 100.0, "a"), (23.0, 114.1, 250.0, "b"), (None, 1.0, 0.0, None)], "lat double, lng double, deposit double, cat string")
    scheme = (
        MappingScheme().derive("twice", "deposit * 2").bin("deposit", [0, 150, 300], ["low", "high"]).code("cat", {"a": 1}, 0)
        .geocode("lat", "lng").onehot(["cat"]).derive("half", lambda d: F.col("deposit") / 2)
    )
    got = apply_scheme(df, scheme)
    rows = got.data.orderBy("deposit").collect()
    assert [r["twice"] for r in rows] == [0.0, 200.0, 500.0]
    assert [r["deposit_bin"] for r in rows] == [None, "low", "high"]
    assert [r["cat_code"] for r in rows] == [0, 1, 0]
    assert [r["cat_a"] for r in rows] == [False, True, False]
    assert rows[0]["cell"] is None and rows[1]["cell"] != rows[2]["cell"]
    assert got.report.count() == 6 and "cat" not in got.data.columns
    assert {r["output"] for r in got.lineage.collect()} >= {"twice", "deposit_bin", "cat_code", "cell", "cat_a", "half"}
    with pytest.raises(ValueError):
        MappingScheme.from_spec([{"op": "explode"}])


def test_aggregate_drops_null_keys_and_orders(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("a", 2, None), ("a", 3, 8.0), (None, 4, 9.0)], "g string, o long, v double")
    row = aggregate(df, ["g"], {"v": "median"}).collect()
    assert [tuple(r) for r in row] == [("a", 5.5)]
    assert aggregate(df, ["g"], {"v": "last"}, ["o"]).first()["v"] == 8.0
    with pytest.raises(ValueError):
        aggregate(df, ["g"], {"v": "first"})


def test_roles_and_columns():
    got = infer_roles(["BRNUM", "CERT", "SIMS_ACQUIRED_DATE", "SIMS_LATITUDE", "amount", "width"], {"width": "target"})
    assert list(got.values()) == ["key", "key", "event", "spatial", "numeric", "target"]
    assert infer_roles(["video"])["video"] == "numeric" and infer_roles(["video"], loose_keys=True)["video"] == "key"
    with pytest.raises(ValueError):
        infer_roles(["a"], {"a": "nonsense"})
    hits = detect_columns(["Store_ID", "fiscal_year", "Latitude", "lng", "Sales", "other"])
    assert hits == {"year": "fiscal_year", "id": "Store_ID", "lat": "Latitude", "lon": "lng", "value": "Sales", "entity_name": None}
    assert detect_columns(["start_lat"])["lat"] == "start_lat"


def test_schema(spark, tmp_path):
    specs = load_schema({"fields": [{"name": "a", "level": "required", "role": "key", "rules": [{"kind": "regex", "pattern": "x|y"}]}, {"name": "gone"}]})
    df = spark.createDataFrame([("xa", 1), ("ay", 2), (None, 3)], "a string, b long")
    assert missing_fields(df, specs) == ["gone"] and unregistered_fields(df, specs) == ["b"] and schema_roles(specs)["a"] == "key"
    row = violations(df, specs).collect()
    assert [(r["violations"], r["samples"], r["severity"]) for r in row] == [(1, ["ay"], "P0")]
    assert tag_roles(df, {"a": "key"}).schema["a"].metadata == {"role": "key"}
    late = spark.createDataFrame([("2030-01-01",), ("1990-01-01",), ("bad",)], "d string")
    got = violations(late, [FieldSpec("d", rules=(Rule("no_future_date"),))], now=datetime(2000, 1, 1)).first()
    assert got["violations"] == 1
    with pytest.raises(ValueError):
        load_schema([{"role": "key"}])
    folder = str(tmp_path / "templates")
    save_template(spark, folder, "my map!", {"entity": "a"})
    save_template(spark, folder, "other", {"entity": "b"})
    assert {r["name"] for r in list_templates(spark, folder).collect()} == {"my_map_", "other"}
