"""Near-duplicate embeddings by HNSW graphs, one per shard of a label.

Equal vectors are one point. The points of a label are dealt to shards of bounded size; every shard gets its graph,
every point searches every shard of its label. The beam is widened until an audit against brute force passes, and
for a point whose whole beam lies above the limit the shard is compared in full, so no neighbour is cut off. A link that
was found from one of its ends only shows in checksums of what each point found and was found by; such points are
compared in full as well, so a link counts at both ends. Cosines are verified in double precision. A task returns link counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import components, ship
from geostrata.llm.hnsw import LINKS, Graph
from geostrata.llm.topk import matrix, usable
from geostrata.session import cut

SLACK = 1e-4  # of single precision, before the check in double
AUDIT = 64
GRAPH = "label {label}, shard long, point long, copies long, v {v}, place int, level int, near array<array<int>>"
EDGE, OUT, IN = range(3)
FOUND = "kind int, a long, b long, part long, links long, seen long"


def points_of(vectors: DataFrame) -> DataFrame:
    """``(point, label, v, first, copies)``: the different usable vectors of each label. Written once, so numbers stay."""
    good = vectors.where(F.col("label").isNotNull() & usable("embedding")).where(F.exists("embedding", lambda x: x != 0))
    same = good.groupBy("label", F.col("embedding").alias("v")).agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    return cut(same.select(F.monotonically_increasing_id().alias("point"), "label", "v", "first", "copies"))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaling by the largest component first keeps squares finite."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _build(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("point")
    graph = Graph(unit(matrix(rows["v"], rows.num_rows)))
    near = [[t[i][t[i] >= 0].tolist() for t in graph.near[: graph.levels[i] + 1]] for i in range(rows.num_rows)]
    return pa.table({
        "label": rows["label"], "shard": rows["shard"], "point": rows["point"], "copies": rows["copies"], "v": rows["v"],
        "place": pa.array(np.arange(rows.num_rows, dtype=np.int32)), "level": pa.array(graph.levels.astype(np.int32)),
        "near": pa.array(near, pa.list_(pa.list_(pa.int32()))),
    })


def _loaded(rows: pa.Table) -> tuple[Graph, np.ndarray]:
    rows = rows.sort_by("place")
    x = unit(matrix(rows["v"], rows.num_rows))
    levels = rows["level"].to_numpy().astype(np.int64)
    lists = rows["near"].to_pylist()
    near = [np.full((len(x), LINKS * (1 if level else 2)), -1, np.int32) for level in range(int(levels.max()) + 1)]
    for i, own in enumerate(lists):
        for level, ids in enumerate(own):
            near[level][i, : len(ids)] = ids
    return Graph(x, levels, near), x


class _Forest:
    """Union of linked points; members of a set are returned as a chain."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        while True:
            up = self.up[at]
            if np.array_equal(up, at):
                return at
            self.up[at] = self.up[up]
            at = up

    def join(self, at: np.ndarray) -> None:
        roots = self.roots(at)
        self.up[roots] = roots.min()

    def chains(self) -> tuple[np.ndarray, np.ndarray]:
        root = self.roots(np.arange(len(self.up)))
        order = np.argsort(root, kind="stable")
        same = root[order][1:] == root[order][:-1]
        return order[:-1][same], order[1:][same]


def links_in(graph: Graph, x: np.ndarray, q: np.ndarray, least: float, beam: int = 32, widest: int = 512, recall: float = 0.95, neighbours: int = 10, whole: bool = False):
    """For each query the places of the points with cosine ``least`` or more: a generator of (query, places)."""
    exact = lambda rows: rows @ x.T
    audit = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(np.int64))
    truth = exact(q[audit])
    k = min(neighbours, len(x))
    kth = -np.partition(-truth, k - 1, 1)[:, k - 1]
    single = q.astype(np.float32)
    while not whole and beam < min(widest, len(x)):
        ids, sims = graph.search(single[audit], beam)
        hit = (sims >= kth[:, None] - 1e-6).sum(1)
        should = (truth >= least).sum(1)
        linked = np.minimum((sims >= least - 1e-6).sum(1), should)
        open_ = sims[:, -1] >= least - SLACK  # will be compared in full
        ok = (np.minimum(hit, k).mean() >= recall * k) and linked[~open_].sum() >= 0.999 * should[~open_].sum()
        if ok:
            break
        beam *= 2
    step = max(1, 8_000_000 // max(1, len(x)))
    narrow = not whole and beam < min(widest, len(x))
    for a in range(0, len(q), step):
        part = q[a:a + step]
        full = np.ones(len(part), bool)
        if narrow:
            ids, sims = graph.search(single[a:a + step], beam)
            full = sims[:, -1] >= least - SLACK
            for i in np.nonzero(~full & (sims[:, 0] >= least - SLACK))[0]:
                near = ids[i][sims[i] >= least - SLACK]
                near = near[x[near] @ part[i] >= least]
                if len(near):
                    yield a + i, near
        if full.any():
            table = exact(part[full])
            for i, row in zip(np.nonzero(full)[0], table):
                near = np.nonzero(row >= least)[0]
                if len(near):
                    yield a + i, near


def _marks(points: np.ndarray) -> np.ndarray:
    """A number per point whose sums tell sets of points apart."""
    x = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _searcher(least: float, whole: bool):
    names = [f.split()[0] for f in FOUND.split(", ")]

    def rows(kind: int, a: np.ndarray, b: np.ndarray, part: int, links: np.ndarray, seen: np.ndarray) -> pa.Table:
        return pa.table([pa.array(np.full(len(a), kind, np.int32)), a, b, np.full(len(a), part, np.int64), links, seen], names=names)

    def run(asked: pa.Table, shard: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        empty = rows(EDGE, none, none, 0, none, none)
        if not asked.num_rows or not shard.num_rows:
            return empty
        shard = shard.sort_by("place")
        graph, x = _loaded(shard)
        q = unit(matrix(asked["q_v"], asked.num_rows))
        if q.shape[1] != x.shape[1]:
            return empty
        mine, theirs, copies = asked["q_point"].to_numpy(), shard["point"].to_numpy(), shard["copies"].to_numpy()
        points, at = np.unique(np.concatenate([mine, theirs]), return_inverse=True)
        mine_at, theirs_at = at[: len(mine)], at[len(mine):]
        forest, counts = _Forest(len(points)), np.zeros(len(mine), np.int64)
        my_marks, their_marks = _marks(mine), _marks(theirs)
        found, by = np.zeros(len(mine), np.int64), np.zeros(len(theirs), np.int64)
        for i, near in links_in(graph, x, q, least, whole=whole):
            other = near[theirs[near] != mine[i]]
            if len(other):
                counts[i] = copies[other].sum()
                found[i] = their_marks[other].sum()
                by[other] += my_marks[i]
                forest.join(np.append(theirs_at[other], mine_at[i]))
        a, b = forest.chains()
        some, met = np.nonzero(counts)[0], np.nonzero(by)[0]
        return pa.concat_tables([
            rows(EDGE, points[a], points[b], 0, np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)),
            rows(OUT, mine[some], mine[some], asked["q_shard"][0].as_py(), counts[some], found[some]),
            rows(IN, theirs[met], theirs[met], asked["q_block"][0].as_py(), np.zeros(len(met), np.int64), by[met])])

    return run


def link(points: DataFrame, least: float, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """``(a, b)``, a forest of the links, and ``(point, links)``, the weighted number of linked points."""
    kind, vector = points.schema["label"].dataType.simpleString(), points.schema["v"].dataType.simpleString()
    width = F.size("v").cast("long").alias("dim")  # vectors of different length are never compared
    sizes = points.groupBy("label", width).agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("shards"))
    dealt = points.withColumn("dim", F.size("v").cast("long")).join(sizes, ["label", "dim"])
    named = lambda i: F.shiftleft("dim", 32) + i
    dealt = dealt.withColumn("shard", named(F.pmod(F.xxhash64("point"), F.col("shards"))))
    graphs = cut(dealt.select("label", "shard", "point", "copies", "v").groupBy("label", "shard").applyInArrow(_build, GRAPH.format(label=kind, v=vector)))
    shards = sizes.select("label", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("i"))
    shards = cut(shards.select("label", "dim", named(F.col("i")).alias("other")))
    asked = graphs.select("label", "shard", "point", "v", F.size("v").alias("dim")).join(shards, ["label", "dim"])
    fresh = lambda c, name: F.col(c).alias(name)  # noqa: E731  (both sides stem from one table: new columns on this one)
    asked = asked.select(fresh("label", "q_label"), fresh("shard", "q_block"), fresh("other", "q_shard"), fresh("point", "q_point"), fresh("v", "q_v"))
    blocks = graphs.withColumn("dim", F.size("v")).join(shards, ["label", "dim"]).withColumnRenamed("other", "block").drop("dim")

    def searched(some: DataFrame, whole: bool) -> DataFrame:
        met = some.groupBy("q_label", "q_block", "q_shard").cogroup(blocks.groupBy("label", "block", "shard"))
        return cut(met.applyInArrow(_searcher(least, whole), FOUND))

    found = searched(asked, False)
    seen = lambda k: F.max(F.when(F.col("kind") == k, F.col("seen")))
    told = cut(found.where(F.col("kind") != EDGE).groupBy(F.col("a").alias("point"), "part").agg(
        F.max(F.when(F.col("kind") == OUT, F.col("links"))).alias("links"), seen(OUT).eqNullSafe(seen(IN)).alias("same")))
    odd = told.where("NOT same").select(F.col("point").alias("q_point"), F.col("part").alias("q_shard"))
    edges, counts = found.where(F.col("kind") == EDGE), told.where("same").select("point", "links")
    if not odd.isEmpty():
        again = searched(asked.join(odd, ["q_point", "q_shard"]), True)
        edges = edges.union(again.where(F.col("kind") == EDGE))
        counts = counts.union(again.where(F.col("kind") == OUT).select("a", "links"))
    return edges.select("a", "b"), counts.groupBy("point").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, least: float = 0.98, shard_rows: int = 16_384) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors (vec_id, embedding, label)``.

    Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do rows without a
    label: they have no links and are their own component. Equal vectors of a label link with each other. Null and
    repeated ids give a row each; other columns are not read; an empty table gives no rows.
    """
    ship(vectors.sparkSession)
    rows = vectors.select("vec_id", "embedding", "label")
    points = points_of(rows)
    edges, counts = link(points, least, shard_rows)
    group = components(edges.where("a <> b")).withColumnRenamed("node", "point")
    named = _named(points, group, counts)
    same = (rows["label"] == named["l"]) & (rows["embedding"] == named["v"])
    whole = rows.join(named, same, "left")
    own = F.coalesce("component_id", "vec_id")
    return whole.select(
        "vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


def _named(points: DataFrame, group: DataFrame, counts: DataFrame) -> DataFrame:
    """``(l, v, copies, links, component_id)`` of every point."""
    group = group.withColumnRenamed("label", "root")
    all_ = points.withColumnRenamed("label", "l").join(group, "point", "left").join(counts, "point", "left")
    all_ = cut(all_.select("l", "v", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "point").alias("root")))
    roots = all_.groupBy("root").agg(F.min("first").alias("component_id"))
    return all_.join(roots, "root").select("l", "v", "copies", "links", "component_id")
