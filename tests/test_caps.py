"""Nothing is lost beyond former limits."""

import pytest

from geostrata.operators import evaluate as E
from geostrata.operators import hazard as H
from geostrata.operators.clean import CleanPlan, clean
from geostrata.operators.infer import infer_mapping
from geostrata.operators.panel import assign_treatment
from geostrata.plans import jobs
from geostrata.session import shared_dir
from geostrata.sources.readers import read_delimited, read_json


def test_json_lines_after_many_blank_lines(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text("\n" * 250 + '{"a": 1}\n{"a": 2}\n')
    assert sorted(r.a for r in read_json(spark, str(path)).collect()) == [1, 2]
    other = tmp_path / "b.json"
    other.write_text("\n" * 250 + '[{"a": 1},\n{"a": 2}]')
    assert read_json(spark, str(other)).count() == 2


def test_files_of_different_separators(spark, tmp_path):
    one, two = tmp_path / "one.txt", tmp_path / "two.txt"
    one.write_text("a,b\n1,2\n")
    two.write_text("a;b\n3;4\n")
    got = read_delimited(spark, [str(one), str(two)])
    assert sorted((int(r.a), int(r.b)) for r in got.collect()) == [(1, 2), (3, 4)]


def panel(spark, wide):
    rows = [(e, y, e % 2, *[float(e * (i + 1) % 97) for i in range(wide)]) for e in range(30) for y in range(2000, 2004)]
    return spark.createDataFrame(rows, ["entity", "year", "event", *[f"x{i}" for i in range(wide)]])


def test_every_leaking_column_counts(spark):
    df = panel(spark, 16)
    assert E.leak_scan(df, "entity", "year").count() == 17
    assert E.leak_scan(df, "entity", "year", limit=12).count() == 12
    health = E.health_checks(df, {"entity": "entity", "time": "year"}, "panel")
    assert health.filter("key = 'leakage'").first()["value"] == 17


def test_every_regressor_is_kept_and_caps_name_what_they_drop(spark):
    df = panel(spark, 16)
    numeric, factors, dropped = H.risk_design(df, "event", ["entity"], None, "year")
    assert len(numeric) == 16 and factors == ["year"] and dropped == []
    numeric, factors, dropped = H.risk_design(df, "event", ["entity"], None, "year", max_numeric=12, max_time=3)
    assert len(numeric) == 12 and factors == [] and dropped == ["x12", "x13", "x14", "x15", "year"]


def test_analyze_profiles_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(jobs, "infer_mapping", lambda df: calls.append(1) or infer_mapping(df))
    assert jobs.run_analyze(spark, panel(spark, 3))["roles"]["time"] == "year"
    assert len(calls) == 1


class Cluster:
    """A session that names a cluster and no shared folder."""

    class conf:
        get = staticmethod(lambda *_: None)

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_a_cluster_must_name_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)


def test_clean_carries_along_the_whole_order(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (1, 3, None), (2, 1, None)], "id long, copy long, v double")
    got = clean(df, CleanPlan().fill("v", "ffill"), order_by=["id", "copy"])
    assert [r.v for r in got.data.orderBy("id", "copy").collect()] == [5.0] * 4


def test_treatment_keeps_rows_without_an_entity(spark):
    df = spark.createDataFrame([("a", 2000, 0), ("a", 2001, 1), (None, 2000, 1)], "e string, y long, m long")
    got = {(r.e, r.y): (r.treated, r.post) for r in assign_treatment(df, "e", "y", mark="m").collect()}
    assert got == {("a", 2000): (1, 0), ("a", 2001): (1, 1), (None, 2000): (0, 0)}
