import numpy as np
import pandas as pd
import pytest

from geostrata.operators import distance
from geostrata.operators.distance import knn_edges, ring_counts
from geostrata.operators.rings import FINE, event_counts, first_exposure, ring_exposure

R = 6371.0088


def haversine(a, b, c, d):
    p, q = np.radians(a), np.radians(c)
    s = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(d - b) / 2) ** 2
    return 2 * R * np.arcsin(np.sqrt(np.minimum(s, 1)))


def cloud(seed=0, n=260, lat0=40.0, lng0=-100.0, spread=0.2):
    """A third at one spot, a third in a tight cluster, the rest spread out; a few without coordinates."""
    rng = np.random.default_rng(seed)
    lat = lat0 + rng.random(n) * spread
    lng = lng0 + rng.random(n) * spread
    lat[: n // 3], lng[: n // 3] = lat0 + 0.1, lng0 + 0.1
    lat[n // 3 : 2 * n // 3] = lat0 + 0.05 + rng.random(n // 3 + (2 * n // 3 - n // 3 * 2)) * 0.01
    lng[n // 3 : 2 * n // 3] = lng0 + 0.05 + rng.random(n // 3 + (2 * n // 3 - n // 3 * 2)) * 0.01
    return pd.DataFrame({"id": np.arange(n), "lat": lat, "lng": lng, "k": np.where(rng.random(n) < 0.7, "a", "b")})


PLACES = [(40.0, -100.0, 0.2), (89.9, 0.0, 0.09), (-0.1, 179.9, 0.2), (60.0, -180.0, 0.3)]


@pytest.mark.parametrize("lat0,lng0,spread", PLACES)
@pytest.mark.parametrize("budget,rows", [(10**9, 10**9), (50, 3)])
def test_ring_counts_equal_brute_force(spark, lat0, lng0, spread, budget, rows):
    p = cloud(3, 150, lat0, lng0, spread)
    p["lng"] = (p["lng"] + 180) % 360 - 180
    edges = [0, 1, 3, 5, 10]
    df = spark.createDataFrame(p)
    got = ring_counts(df, df, edges, ["id"], match=["k"], pair_budget=budget, tile_rows=rows).toPandas().set_index("id")
    d = haversine(p["lat"].to_numpy()[:, None], p["lng"].to_numpy()[:, None], p["lat"].to_numpy(), p["lng"].to_numpy())
    same = p["k"].to_numpy()[:, None] == p["k"].to_numpy()
    for j, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        want = (same & (d >= a) & (d < b)).sum(axis=1)
        assert (got[f"ring_{j}"].reindex(p["id"]).fillna(0).to_numpy() == want).all()


def test_ring_counts_write_and_shuffle_locations_not_pairs(spark, monkeypatch):
    rng, written, whole = np.random.default_rng(8), [], distance.cut
    p = pd.DataFrame({"id": np.arange(1500), "lat": 40 + rng.random(1500) * 0.3, "lng": -100 + rng.random(1500) * 0.3, "year": rng.integers(0, 4, 1500)})
    df = spark.createDataFrame(p)
    lost = spark.createDataFrame([(-1, float("nan"), -100.0, 0)], df.schema)

    def counting(rows):
        out = whole(rows)
        written.append(out.count())
        return out

    monkeypatch.setattr(distance, "cut", counting)
    edges = [0, 1, 3, 5, 10]
    got = ring_counts(df.union(lost), df.union(lost), edges, ["id"], split=["year"], closed="right")
    assert sum(written) <= 3 * len(p)  # box pairs were a hundred times as many
    got = got.toPandas().set_index(["id", "year"])
    d = haversine(p["lat"].to_numpy()[:, None], p["lng"].to_numpy()[:, None], p["lat"].to_numpy(), p["lng"].to_numpy())
    for y in range(4):
        there = got.xs(y, level="year").reindex(p["id"]).fillna(0)
        for j, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            inside = (d <= b) & ((d > a) | (a == 0)) & (p["year"].to_numpy() == y)
            assert (there[f"ring_{j}"].to_numpy() == inside.sum(axis=1)).all()
    assert -1 not in got.index.get_level_values("id")


def test_exposure_leaves_the_event_itself_out(spark):
    p = cloud(5).assign(acq_year=lambda x: np.where(x["id"] % 4 == 0, 2000.0, np.nan))
    p.loc[p["id"] % 31 == 7, "lat"] = np.nan
    p = p.rename(columns={"k": "class", "id": "entity"})
    df = spark.createDataFrame(p).selectExpr("entity", "class", "CASE WHEN isnan(lat) THEN NULL ELSE lat END AS lat", "lng", "CASE WHEN isnan(acq_year) THEN NULL ELSE acq_year END AS acq_year")
    got = ring_exposure(df).toPandas().set_index("entity")
    ok = p.dropna(subset=["lat"])
    events = ok.dropna(subset=["acq_year"])
    assert set(got.index) == set(events["entity"])
    for _, e in events.iterrows():
        others = ok[(ok["class"] == e["class"]) & (ok["entity"] != e["entity"])]
        d = haversine(e["lat"], e["lng"], others["lat"].to_numpy(), others["lng"].to_numpy())
        assert got.loc[e["entity"], "n_same_ind_10km"] == (d < 10).sum()
        for a, b in FINE:
            assert got.loc[e["entity"], f"same_ind_ring_{a:g}_{b:g}km"] == ((d >= a) & (d < b)).sum()


def test_first_exposure_adds_weights_of_the_first_year_only(spark):
    ent = spark.createDataFrame([(1, "x", 1990, 40.0, -100.0)], "entity long, class string, first_year long, lat double, lng double")
    ev = spark.createDataFrame(
        [("x", 1989, 40.0, -100.0), ("x", 1995, 40.0, -100.0), ("x", 1995, 40.02, -100.0), ("x", 1999, 40.0, -100.0), ("y", 1991, 40.0, -100.0)],
        "class string, event_year long, lat double, lng double")
    row = first_exposure(event_counts(ent, ev)).collect()
    assert [(r["entity"], r["first_event_year"], r["strength_t0"]) for r in row] == [(1, 1995, 1.6)]


@pytest.mark.parametrize("metric", ["plane", "sphere"])
@pytest.mark.parametrize("k", [1, 5])
def test_knn_equals_brute_force(spark, metric, k):
    p = cloud(11, 200)
    got = knn_edges(spark.createDataFrame(p), k, metric=metric).toPandas()
    if metric == "plane":
        xyz = p[["lng", "lat"]].to_numpy()
    else:
        la, ln = np.radians(p["lat"]), np.radians(p["lng"])
        xyz = np.column_stack([np.cos(la) * np.cos(ln), np.cos(la) * np.sin(ln), np.sin(la)])
    d = np.round(np.sqrt(((xyz[:, None] - xyz) ** 2).sum(axis=2)), 9)
    for i in range(len(p)):
        order = sorted((x for x in range(len(p)) if x != i), key=lambda x: (d[i, x], x))[:k]
        mine = got[got["src"] == i].sort_values("rank")
        np.testing.assert_allclose(mine["d"].to_numpy(), d[i, order], atol=2e-9)
        assert len(set(mine["dst"])) == k and i not in set(mine["dst"])


def test_knn_with_fewer_points_than_neighbours(spark):
    p = pd.DataFrame({"id": [1, 2, 3], "lat": [0.0, 1.0, 2.0], "lng": [0.0, 0.0, 0.0]})
    got = knn_edges(spark.createDataFrame(p), 5).groupBy("src").count().collect()
    assert {r["count"] for r in got} == {2}
