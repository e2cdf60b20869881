"""Two-way effects, nearest neighbours and hazard fits on data that are hard for a naive solver."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geostrata.operators import hazard as H
from geostrata.operators import moran as M
from geostrata.operators import twfe as T
from geostrata.operators import distance as D
from geostrata.operators.distance import knn_edges


def scattered(entities=10_000, periods=24, seed=4):
    """An unbalanced panel in which nearly every entity has a presence pattern of its own."""
    rng = np.random.default_rng(seed)
    here = rng.random((entities, periods)) < 0.4
    e, t = np.nonzero(here)
    x = rng.normal(size=len(e)) + t * 0.3 + e % 7
    return pd.DataFrame({"e": e, "t": t, "x": x, "y": 2 * x + np.sin(t) * 5 + (e % 13) + rng.normal(size=len(e))})


def within(d, columns):
    """The transform by the dense period system."""
    own = d.groupby("e")["t"].transform("size").to_numpy()
    periods = d["t"].max() + 1
    hot = np.zeros((len(d), periods))
    hot[np.arange(len(d)), d["t"]] = 1
    means = np.zeros((d["e"].max() + 1, periods))
    np.add.at(means, d["e"].to_numpy(), hot / own[:, None])
    left = hot - means[d["e"]]
    out = {}
    for c in columns:
        v = d[c].to_numpy() - d.groupby("e")[c].transform("mean").to_numpy()
        out[c] = v - left @ np.linalg.lstsq(left, v, rcond=None)[0]
    return out


def test_exact_effects_with_ten_thousand_patterns(spark):
    d = scattered()
    want = within(d, ["x", "y"])
    fit = T.within_ols(spark.createDataFrame(d), "y", ["x"], "e", "t")
    assert fit.coef("x") == pytest.approx(want["x"] @ want["y"] / (want["x"] @ want["x"]), abs=1e-10)
    assert fit.extra["patterns"] > 9000 and fit.extra["rounds"] <= 24
    got = T.demean(spark.createDataFrame(d), ["x", "y"], "e", "t", "exact").toPandas().sort_values(["e", "t"])
    for c in ("x", "y"):
        np.testing.assert_allclose(got[c].to_numpy(), want[c], atol=1e-8)


def test_collinear_and_absorbed_regressors_are_dropped(spark):
    d = scattered(300)
    d = d.assign(twice=2 * d["x"] + d["t"], flat=d["e"] * 1.0, z=np.cos(d["e"] * d["t"]))
    df = spark.createDataFrame(d)
    fit = T.within_ols(df, "y", ["x", "flat", "twice", "z"], "e", "t")
    assert fit.extra["dropped"] == ["flat", "twice"]
    alone = T.within_ols(df, "y", ["x", "z"], "e", "t")
    for term in ("x", "z"):
        assert fit.coef(term) == pytest.approx(alone.coef(term), abs=1e-9)
        assert fit.std_err(term) == pytest.approx(alone.std_err(term), abs=1e-9)
    assert [r[1:] for r in fit.rows() if r[0] in ("flat", "twice")] == [(None, None, None, None)] * 2
    none = T.within_ols(df, "y", ["flat"], "e", "t")
    assert none.extra["dropped"] == ["flat"] and none.coef("flat") is None


def test_disconnected_panels_converge(spark):
    d = pd.DataFrame([(e, t, float(e * t % 5), float((e + t) % 3)) for e in range(8) for t in range(6) if (e < 4) == (t < 3)], columns=["e", "t", "x", "y"])
    want = within(d, ["x", "y"])
    fit = T.within_ols(spark.createDataFrame(d), "y", ["x"], "e", "t")
    assert fit.coef("x") == pytest.approx(want["x"] @ want["y"] / (want["x"] @ want["x"]), abs=1e-10)


def neighbours(p, k):
    x, ids, out = p[["lng", "lat"]].to_numpy(), p["id"].to_numpy(), set()
    for i in range(len(p)):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 9)
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out |= {(int(ids[i]), int(ids[j]), r + 1) for r, j in enumerate(order)}
    return out


def test_nearest_neighbours_of_a_city_a_desert_and_an_outlier(spark):
    rng = np.random.default_rng(0)
    lattice = np.array([(i / 10, j / 10) for i in range(12) for j in range(12)])
    x = np.vstack([rng.normal(0, 0.001, (900, 2)), rng.uniform(-50, 50, (150, 2)), [[500, 500]], [[3, 3]] * 40, lattice])
    p = pd.DataFrame({"id": rng.permutation(len(x)), "lng": x[:, 0], "lat": x[:, 1]})
    told = {}
    got = {(r.src, r.dst, r["rank"]) for r in knn_edges(spark.createDataFrame(p), 6, report=told).collect()}
    assert got == neighbours(p, 6)
    assert told["rounds"] <= 14 and told["pairs"] < 400 * len(p)


@pytest.mark.parametrize("tile", [40, 8192])
def test_nearest_neighbours_over_many_tiles_take_two_rounds(spark, monkeypatch, tile):
    monkeypatch.setattr(D, "TILE_PLACES", tile, raising=False)
    monkeypatch.setattr(D, "TILE_SAMPLE", 10, raising=False)
    monkeypatch.setattr(D, "TILE_ROWS", 7)  # asking places of a tile are dealt over tasks
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 0.001, (500, 2)), rng.uniform(-50, 50, (80, 2)), [[500, 500]], [[3, 3]] * 30, [[0.0, -0.0], [-0.0, 0.0]],
                   [[7 + i * 1e-10, 7] for i in range(60)], [(20 + i / 10, 20 + j / 10) for i in range(9) for j in range(9)]])
    p = pd.DataFrame({"id": rng.permutation(len(x)), "lng": x[:, 0], "lat": x[:, 1]})
    odd = pd.DataFrame({"id": [9001, 9002], "lng": [np.inf, 1.0], "lat": [1.0, np.nan]})
    told = {}
    got = knn_edges(spark.createDataFrame(pd.concat([p, odd])), 6, report=told)
    assert {(r.src, r.dst, r["rank"]) for r in got.collect()} == neighbours(p, 6)
    assert told["rounds"] == (2 if tile == 40 else 1) and told["pairs"] < 400 * len(p)


def test_distances_round_as_the_engine_does(spark):
    gaps = [0.0000000005, 0.1000000005, 2.4999999995, 0.3, 1234.5678901235, 7.0000000015]
    p = pd.DataFrame([(2 * i + j, 1e4 * i, g * j) for i, g in enumerate(gaps) for j in range(2)], columns=["id", "lat", "lng"])
    got = {r.src // 2: r.d for r in knn_edges(spark.createDataFrame(p), 1).collect()}
    want = spark.createDataFrame([(i, g) for i, g in enumerate(gaps)], "i long, g double").selectExpr("i", "round(g, 9) AS d").collect()
    assert got == {r.i: r.d for r in want}


@pytest.mark.parametrize("n", [0, 1, 2, 6])
def test_fewer_points_than_neighbours(spark, n):
    p = pd.DataFrame({"id": np.arange(n), "lng": np.arange(n) * 1.5, "lat": np.zeros(n)})
    df = spark.createDataFrame(p) if n else spark.createDataFrame([], "id long, lng double, lat double")
    assert {(r.src, r.dst, r["rank"]) for r in knn_edges(df, 6).collect()} == neighbours(p, 6)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_every_replicate_is_one_to_one(n):
    slots = M.bijection(n, 3)
    seen = [tuple(slots(np.arange(n), r).tolist()) for r in range(1, 40)]
    assert all(sorted(s) == list(range(n)) for s in seen)
    assert n < 10 or len(set(seen)) == 39
    assert n < 97 or abs(np.mean(seen, axis=0) - (n - 1) / 2).max() < n / 2 / np.sqrt(3 * 39) * 6  # each rank goes everywhere


def test_permutation_moran_is_the_same_by_task_by_shuffle_and_by_hand(spark, monkeypatch):
    rng = np.random.default_rng(2)
    n = 120
    p = pd.DataFrame({"id": rng.permutation(1000)[:n], "v": rng.normal(size=n)})
    edges = pd.DataFrame([(i, int(j), 0.25) for i in p["id"] for j in rng.choice(p["id"], 4, replace=False) if i != j], columns=["src", "dst", "w"])
    nodes, w = spark.createDataFrame(p), spark.createDataFrame(edges)
    monkeypatch.setattr(M, "AT_ONCE", 16)
    got = [M.moran_permutation(nodes, w, "v", permutations=39, seed=5, broadcast_nodes=b).first() for b in (1000, 10)]
    order = p.sort_values("id").reset_index(drop=True)
    at, z = {i: k for k, i in enumerate(order["id"])}, (order["v"] - order["v"].mean()).to_numpy()
    s, d = edges["src"].map(at).to_numpy(), edges["dst"].map(at).to_numpy()

    def index(now):
        return (edges["w"].to_numpy() * now[s] * now[d]).sum() / (z @ z)

    slots, drawn = M.bijection(n, 5), []
    for r in range(1, 40):
        now = np.empty(n)
        now[slots(np.arange(n), r)] = z
        drawn.append(index(now))
    for g in got:
        assert g["moran_i"] == pytest.approx(index(z)) and g["p_value"] == (sum(x >= index(z) - 1e-12 for x in drawn) + 1) / 40


def hazard_table(n=4000, seed=6):
    rng = np.random.default_rng(seed)
    d = pd.DataFrame({"x": rng.integers(0, 9, n).astype(float), "g": rng.choice(["a", "b", "c"], n)})
    d.loc[rng.random(n) < 0.1, "x"] = np.nan
    eta = -2 + 0.2 * d["x"].fillna(4) + d["g"].map({"a": 0.0, "b": 0.5, "c": -0.4})
    return d.assign(event=(rng.random(n) < 1 - np.exp(-np.exp(eta))).astype(int))


def test_cells_replace_rows_and_scores_vanish_at_the_fit(spark):
    d = hazard_table()
    df = spark.createDataFrame(d).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    fit = H.fit_cloglog(df, "event", ["x"], ["g"])
    cells = fit.design.cells(df, "event")
    assert cells.count() <= 9 * 3 and tuple(cells.agg(F.sum("n"), F.sum("e")).first()) == (len(d), d["event"].sum())
    x = np.column_stack([np.ones(len(d)), d["x"].fillna(d["x"].median()), d["g"] == "b", d["g"] == "c"]).astype(float)
    b = np.array([fit.intercept, *fit.coefs])
    p, slope = 1 - np.exp(-np.exp(x @ b)), np.exp(x @ b - np.exp(x @ b))
    assert np.abs(x.T @ ((d["event"] - p) * slope / (p * (1 - p)))).max() < 1e-6
    info = (x * (slope ** 2 / (p * (1 - p)))[:, None]).T @ x
    errors = [r[4] for r in fit.rows]
    np.testing.assert_allclose([errors[-1], *errors[:-1]], np.sqrt(np.diag(np.linalg.inv(info))), rtol=1e-7)


def test_levels_without_events_and_repeated_regressors_have_no_error(spark):
    d = hazard_table().fillna(4.0).assign(event=lambda t: np.where(t["g"] == "c", 0, t["event"]), again=lambda t: t["x"] * 2)
    df = spark.createDataFrame(d)
    rows = {r[0]: r for r in H.fit_cloglog(df, "event", ["x", "again"], ["g"]).rows}
    assert rows["again"][4] is None and rows["x"][4] > 0
    assert rows["g_c"][3] < -10 and rows["g_b"][4] < 1
    with pytest.raises(ValueError):
        H.fit_cloglog(df.withColumn("event", F.lit(0)), "event", ["x"])
