import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geostrata.functions.columns import nan_to_null
from geostrata.operators.ranks import carry_fill, group_quantile, quantiles, running_total


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(1)
    n = 3000
    skewed = np.where(rng.random(n) < 0.4, 7.0, rng.lognormal(3, 2, n).round(3))
    return pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "b": skewed, "g": np.where(rng.random(n) < 0.6, "hot", "cold")})


@pytest.mark.parametrize("limit", [50, 400, 200_000])
def test_quantiles_are_exact_however_narrow_the_brackets(spark, frame, limit):
    ps = (0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0)
    got = quantiles(spark.createDataFrame(frame), {"a": ps, "b": ps}, direct_rows=limit)
    for c in ("a", "b"):
        for p in ps:
            assert got[c, p] == pytest.approx(frame[c].quantile(p), abs=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert quantiles(df, {"x": (0.5,)}) == {("x", 0.5): None}


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running_total(spark, frame, descending, inclusive):
    t = frame.groupby(["g", "b"]).size().rename("n").reset_index()
    got = running_total(spark.createDataFrame(t), "b", {"s": "n"}, ["g"], descending, inclusive, buckets=7).toPandas()
    t = t.sort_values("b", ascending=not descending)
    t["want"] = t.groupby("g")["n"].cumsum() - (0 if inclusive else t["n"])
    m = got.merge(t, on=["g", "b"])
    assert len(m) == len(t) and (m["s"] == m["want"]).all()


@pytest.mark.parametrize("forward", [True, False])
def test_carry_fill_crosses_buckets(spark, frame, forward):
    f = frame.assign(v=frame["a"].where(frame["id"] % 97 == 0))
    got = carry_fill(nan_to_null(spark.createDataFrame(f)), "v", "id", forward=forward, buckets=9).select("id", "v").toPandas().sort_values("id")
    want = f["v"].ffill() if forward else f["v"].bfill()
    np.testing.assert_allclose(got["v"].astype(float).to_numpy(), want.to_numpy(), equal_nan=True)


def test_group_quantile(spark, frame):
    got = group_quantile(spark.createDataFrame(frame), ["g"], "b", 0.3, "q").toPandas().set_index("g")["q"]
    for g, part in frame.groupby("g"):
        assert got[g] == pytest.approx(part["b"].quantile(0.3))


def test_no_global_window(spark, frame):
    plan = running_total(spark.createDataFrame(frame).groupBy("b").agg(F.count("*").alias("n")), "b", {"s": "n"})._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan or "hashpartitioning" in plan


@pytest.mark.parametrize("forward", [True, False])
def test_carry_fill_along_several_columns_of_text_and_number(spark, forward):
    rows = [(1, f"g{i // 7:03d}", i % 7, float(i) if i % 11 == 0 else None) for i in range(300)]
    df = spark.createDataFrame(rows[::-1], "same long, name string, pos long, v double")
    got = carry_fill(df, "v", ["same", "name", "pos"], forward=forward, buckets=5).orderBy("name", "pos").toPandas()["v"]
    s = pd.Series([r[3] for r in rows])
    np.testing.assert_allclose(got.to_numpy(), (s.ffill() if forward else s.bfill()).to_numpy(), equal_nan=True)


def test_carry_fill_spreads_a_constant_order(spark):
    df = spark.range(4000).select(F.lit("x").alias("o"), "id", F.when(F.col("id") % 50 == 0, F.col("id")).alias("v"))
    plan = carry_fill(df, "v", "o", buckets=8)
    parts = spark.read.parquet(*plan.inputFiles()).groupBy("_part").count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 1000
    assert plan.filter("v is null").count() < 4000 and plan.count() == 4000
