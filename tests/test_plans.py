"""Plans keep to the shapes that scale."""

import os
import re

import pandas as pd
import pytest
from oracle import TESTDATA

from __spark_entry__ import queries
from geostrata.operators.profile import top_values
from geostrata.operators.skew import hot_key_join, spread_join
from geostrata.session import cut, shared_dir

SF_DIR = f"{TESTDATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ring_exposure", "nb_knn", "nb_contiguity", "spatial_lag", "k_ring", "event_pairs", "did_panel", "person_period", "clean_dedup_first", "panel_growth", "auc"])
def test_no_cross_join_no_python(spark, name):
    plan = plan_of(queries()[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert bad not in plan


def test_scan_reads_two_columns_and_pushes_the_filter(spark):
    df = spark.read.parquet(f"{SF_DIR}/orders.parquet").filter("o_totalprice > 100").select("o_orderkey", "o_totalprice")
    plan = df._jdf.queryExecution().toString()
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>", plan)
    dirty = plan_of(queries()["outlier_iqr"](spark, SF_DIR))
    assert "o_orderpriority" not in re.findall(r"ReadSchema: (struct<[^>]*>)", dirty)[0]


def test_deduplication_is_an_aggregation(spark):
    plan = plan_of(queries()["clean_dedup_first"](spark, SF_DIR))
    assert "Window" not in plan and "Aggregate" in plan


def test_top_values_limit_rows_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x")], "c string, d string")
    assert "WindowGroupLimit" in plan_of(top_values(df, ["c", "d"], 1))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_key_join_equals_a_join(spark, how):
    big = pd.DataFrame({"k": ["hot"] * 600 + [f"k{i % 90}" for i in range(400)] + [None] * 3, "v": range(1003)})
    df = spark.createDataFrame(big)
    unique = df.filter("k is not null and k <> 'k7'").groupBy("k").count().withColumnRenamed("count", "n")
    got = hot_key_join(df, unique, ["k"], "n", how)
    want = df.join(unique, ["k"], how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_spread_join_equals_a_join(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": ["hot"] * 600 + [f"k{i % 90}" for i in range(400)], "v": range(1000)}))
    sizes = df.groupBy("k").count()
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("none", 4)], "k string, w long")
    got = spread_join(df, other, ["k"], sizes, "count", salts=8)
    assert sorted(map(tuple, got.select("k", "v", "w").collect())) == sorted(map(tuple, df.join(other, "k").select("k", "v", "w").collect()))


def test_cut_uses_the_shared_folder(spark):
    df = cut(spark.range(10).withColumnRenamed("id", "x"))
    path = df.inputFiles()[0]
    assert shared_dir(spark).split("/")[-1] in path and df.count() == 10
