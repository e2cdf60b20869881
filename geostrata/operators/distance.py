"""Distance joins on the sphere: counting by ring, pairs within a radius, nearest neighbours.

Points become 3-D coordinates, so a cube grid needs no care at poles or the date line and a chord
never exceeds the great-circle distance it stands for.

``ring_counts`` shuffles locations, never pairs: a source goes to the cube around it, a target to the few cubes within
reach, and a task takes one cube. There both sides are split into small boxes of points. A pair of boxes that lies inside
one ring as a whole is settled by counts; only locations of boxes crossed by a ring edge are compared, by chord, and by the
exact haversine next to an edge. Copies of one location are one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geostrata.functions.columns import (
    EARTH_RADIUS_KM,
    chord_km,
    col,
    sphere_xyz,
)
from geostrata.operators.skew import hot_key_join, spread_join
from geostrata.session import cut

AXES = ("x", "y", "z")
SLACK_KM = 1e-7  # far above rounding of 3-D coordinates, far below any ring edge
PAIR_BUDGET = 100_000_000
BLOCK_PAIRS = 250_000  # distances that a task holds at a time
TILE_ROWS = 50_000
CUBE_ROWS = 500  # sources of a cube on average, at least
LEAF_ROWS = 32


def _locations(df: DataFrame, lat: str, lng: str, keys: Sequence[str]) -> DataFrame:
    """One row per distinct (keys, coordinates) with its row count and 3-D position."""
    return (
        df.filter((F.abs(F.col(lat).cast("double")) < math.inf) & (F.abs(F.col(lng).cast("double")) < math.inf))  # nor null nor NaN
        .groupBy(*keys, F.col(lat).cast("double").alias("lat"), F.col(lng).cast("double").alias("lng"))
        .agg(F.count("*").alias("n"))
        .withColumns(dict(zip(AXES, sphere_xyz("lat", "lng"))))
    )


def _near_edges(edges: Sequence[float]) -> list[tuple[float, float]]:
    """Chords surely inside and surely outside each ring edge."""
    return [(chord_km(e) - SLACK_KM, chord_km(e) + SLACK_KM) for e in edges]


def _counted(edges: Sequence[float], closed: str, match: Sequence[str], split: Sequence[str], pair_budget: int):
    """Ring counts of the sources (``_side`` 0) of one group of rows over its targets, for ``applyInArrow``."""
    edges, match, split, chords, leaf = [float(e) for e in edges], list(match), list(split), _near_edges(edges), LEAF_ROWS
    m, diameter, names = len(edges) - 1, 2 * EARTH_RADIUS_KM, [f"ring_{j}" for j in range(len(edges) - 1)]

    def leaves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the points and starts of their leaves: halved along the widest axis down to ``leaf`` points."""
        parts, todo = [], [np.arange(len(x))]
        while todo:
            at = todo.pop()
            if len(at) <= leaf:
                parts.append(at)
                continue
            axis, half = int(np.argmax(np.ptp(x[at], axis=0))), len(at) // 2
            at = at[np.argpartition(x[at, axis], half)]
            todo += [at[half:], at[:half]]
        return np.concatenate(parts), np.cumsum([0, *(len(q) for q in parts)])

    def passed(d2: np.ndarray, s_at: np.ndarray, t_at: np.ndarray) -> np.ndarray:
        """How many ring edges each (source, target) lies beyond; the exact distance decides close to an edge."""
        out, close = np.zeros(d2.shape, np.int8), np.zeros(d2.shape, bool)
        for e, (low, high) in zip(edges, chords):
            if e <= 0:
                out += 1
                continue
            over = d2 > max(low, 0.0) ** 2
            out += over
            over &= d2 <= high * high
            close |= over
        i, j = np.nonzero(close)
        if len(i):
            p, q = s_at[i], t_at[j]
            y, z = np.sin((q[:, 0] - p[:, 0]) / 2), np.sin((q[:, 1] - p[:, 1]) / 2)
            d = np.arcsin(np.sqrt(np.minimum(1.0, y * y + np.cos(p[:, 0]) * np.cos(q[:, 0]) * z * z))) * diameter
            out[i, j] = sum((d >= e if closed == "left" else d > e) if e > 0 else np.ones(len(d), bool) for e in edges)
        return out

    def run(table: pa.Table) -> pa.Table:
        side = table.column("_side").to_numpy()
        both = np.column_stack([table.column(c).to_numpy() for c in ("x", "y", "z")])
        angle = np.radians(np.column_stack([table.column(c).to_numpy() for c in ("lat", "lng")]))
        mine, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        code, kinds, names_of = np.zeros(len(theirs), np.int64), 1, []
        for c in split:
            told = table.column(c).combine_chunks().take(pa.array(theirs)).dictionary_encode(null_encoding="encode")
            names_of.append((told.dictionary, kinds))
            code += kinds * told.indices.to_numpy(zero_copy_only=False)
            kinds *= max(1, len(told.dictionary))
        present, code = np.unique(code, return_inverse=True)  # combinations that occur
        width = len(present)
        out = np.zeros((len(mine), width, m), np.int64)
        if len(mine) and len(theirs):
            order, t_cut = leaves(both[theirs])
            theirs, code = theirs[order], code[order]
            t, t_at, t_n = both[theirs], angle[theirs], table.column("n").to_numpy()[theirs]
            t_lo, t_hi = np.minimum.reduceat(t, t_cut[:-1]), np.maximum.reduceat(t, t_cut[:-1])
            sums = np.zeros((len(t_cut) - 1, width), np.int64)
            np.add.at(sums, (np.repeat(np.arange(len(t_cut) - 1), np.diff(t_cut)), code), t_n)
            order, s_cut = leaves(both[mine])
            for first, last in zip(s_cut[:-1], s_cut[1:]):
                rows = order[first:last]
                s, s_at = both[mine[rows]], angle[mine[rows]]
                lo, hi = s.min(0), s.max(0)
                near = np.sqrt((np.maximum(0.0, np.maximum(lo - t_hi, t_lo - hi)) ** 2).sum(1))
                far = np.sqrt((np.maximum(hi - t_lo, t_hi - lo) ** 2).sum(1))
                met = near <= chords[-1][1]
                if edges[0] > 0:
                    met &= far >= chords[0][0]
                crossed = met.copy()
                for j in range(m):
                    whole = met & (far < chords[j + 1][0])
                    if edges[j] > 0:
                        whole &= near > chords[j][1]
                    if whole.any():
                        out[rows, :, j] += sums[whole].sum(0)
                        crossed &= ~whole
                hit = np.flatnonzero(crossed)
                if not len(hit):
                    continue
                sizes = t_cut[hit + 1] - t_cut[hit]
                at = np.repeat(t_cut[hit] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                step = max(1, pair_budget // len(rows))
                for begin in range(0, len(at), step):
                    some = at[begin:begin + step]
                    d2 = np.zeros((len(rows), len(some)))
                    for axis in range(3):
                        gap = s[:, axis, None] - t[some, axis]
                        gap *= gap
                        d2 += gap
                    ring = passed(d2, s_at, t_at[some])
                    place = (np.arange(len(rows))[:, None] * width + code[some]) * (m + 2) + ring
                    weight = t_n[some]
                    weight = None if (weight == 1).all() else np.broadcast_to(weight, ring.shape).ravel()
                    found = np.bincount(place.ravel(), weight, len(rows) * width * (m + 2)).reshape(len(rows), width, m + 2)
                    out[rows] += found[:, :, 1:m + 1].astype(np.int64)
        i, j = np.nonzero(out.any(2))
        rows = table.take(pa.array(mine[i])).select([*match, "lat", "lng"])
        columns = [*rows.columns, *(values.take(pa.array(present[j] // above % len(values))) for values, above in names_of)]
        return pa.table([*columns, *(pa.array(out[i, j, r]) for r in range(m))], names=[*match, "lat", "lng", *split, *names])

    return run


def ring_counts(
    sources: DataFrame,
    targets: DataFrame,
    edges: Sequence[float],
    source_id: Sequence[str],
    match: Sequence[str] = (),
    split: Sequence[str] = (),
    closed: str = "left",
    lat: str = "lat",
    lng: str = "lng",
    pair_budget: int = PAIR_BUDGET,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Targets around each source by distance ring, without listing the pairs.

    ``edges`` are increasing ring edges in km; the result has one row per source (and ``split``
    value of the targets) with columns ``ring_0 .. ring_{m-1}``. Sources without any target inside
    the outer edge are absent. Only rows with equal ``match`` columns are compared.

    Cubes at least three times as wide as the outer edge hold the sources; a target goes to the cubes within reach, eight at
    most. A cube with more than ``tile_rows`` locations of either side is dealt over tasks of so many; a task compares
    at most ``pair_budget`` pairs at a time.
    """
    match, split, source_id = list(match), list(split), list(source_id)
    ring_cols = [f"ring_{j}" for j in range(len(edges) - 1)]
    reach = chord_km(edges[-1]) + SLACK_KM
    here = sources.select(*source_id, *match, F.col(lat).cast("double").alias("lat"), F.col(lng).cast("double").alias("lng"))
    s_loc = cut(_locations(here, "lat", "lng", match))
    t_loc = cut(_locations(targets, lat, lng, match + split))

    size = 3 * reach
    cubes = s_loc.select(F.count("*").alias("n"), F.approx_count_distinct(F.struct(*match, *_cube(size))).alias("k")).first()
    fill = cubes["n"] / max(1, cubes["k"])
    while fill < CUBE_ROWS and size < 2 * EARTH_RADIUS_KM:  # thinly filled cubes are joined
        size, fill = 2 * size, 4 * fill
    cells = ["_c0", "_c1", "_c2"]
    key = [*match, *cells]
    own = s_loc.withColumns(dict(zip(cells, _cube(size))))
    held = cut(own.groupBy(*key).agg(F.ceil(F.count("*") / tile_rows).alias("_sp")))
    reached = t_loc
    for c, low, high in zip(cells, _cube(size, -reach), _cube(size, reach)):
        reached = reached.withColumn(c, F.explode(F.array_distinct(F.array(low, high))))
    reached = reached.join(held, key, "left_semi")
    parts = held.filter("_sp > 1")
    more = reached.groupBy(*key).agg(F.ceil(F.count("*") / tile_rows).alias("_tp")).filter("_tp > 1")

    def dealt(rows: DataFrame, side: int, mine: str, other: str) -> DataFrame:
        """Rows of one side by place, repeated for every part of the other side."""
        for counts in (parts, more):
            rows = rows.join(F.broadcast(counts), key, "left")  # a row per tile_rows locations at most
        ways = [F.coalesce(F.col(c), F.lit(1)) for c in (mine, other)]
        rows = rows.withColumn("_m", F.pmod(F.xxhash64("lat", "lng"), ways[0]).cast("int"))
        rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), (ways[1] - 1).cast("int"))))
        empty = [F.lit(None).cast(t_loc.schema[c].dataType).alias(c) for c in split] if side == 0 else split
        order = ["_m", "_o"] if side == 0 else ["_o", "_m"]
        return rows.select(*key, *[F.col(c).alias(n) for c, n in zip(order, ("_i", "_j"))], F.lit(side).alias("_side"), "lat", "lng", *AXES, "n", *empty)

    rows = dealt(own, 0, "_sp", "_tp").unionByName(dealt(reached, 1, "_tp", "_sp"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in t_loc.select(*match, "lat", "lng", *split).schema]
    counted = rows.groupBy(*key, "_i", "_j").applyInArrow(
        _counted(edges, closed, match, split, min(pair_budget, BLOCK_PAIRS)), ", ".join([*kinds, *[f"{c} long" for c in ring_cols]]))
    per_place = counted.groupBy(*match, "lat", "lng", *split).agg(*[F.sum(c).cast("long").alias(c) for c in ring_cols])
    place = [*match, "lat", "lng"]
    return spread_join(here, per_place, place, s_loc, "n").select(*source_id, *split, *ring_cols)


def _cube(size: float, shift: float = 0.0) -> list[Column]:
    """Numbers of the cube that holds a point, moved by ``shift`` along every axis."""
    return [F.floor((F.col(a) + shift) / size) for a in AXES]


# --- nearest neighbours ------------------------------------------------------------------------


def knn_edges(
    points: DataFrame,
    k: int,
    node: str = "id",
    lat: str = "lat",
    lng: str = "lng",
    metric: str = "plane",
    report: dict | None = None,
) -> DataFrame:
    """``k`` nearest other points of each point: ``(src, dst, d, rank)``.

    ``plane`` measures on raw (lng, lat) degrees, ``sphere`` on the unit sphere. Ties (equal to nine decimals) go to the
    smaller id. At one location only the k+1 smallest ids can be anybody's neighbour, which keeps stacked copies from
    pairing up. Points without finite coordinates have no neighbours and are nobody's.

    Points are dealt over tiles of space of about ``TILE_PLACES`` points each (``_tiles``), so a city and a desert have tiles
    of their own scale. A task searches one tile. Only places whose ball around the k-th other point of their tile
    crosses a wall of it ask the tiles which that ball meets, a second time; all others are done. ``report`` gets the rounds and
    the number of pairs compared.
    """
    if metric == "plane":
        coords = [col(lng).cast("double"), col(lat).cast("double")]
    elif metric == "sphere":
        coords = sphere_xyz(lat, lng, 1.0)
    else:
        raise ValueError(f"unknown metric: {metric}")
    dims = [f"_x{i}" for i in range(len(coords))]
    pts = points.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull()).select(
        F.col(node).alias("src"), *[c.alias(d) for c, d in zip(coords, dims)]
    )
    for d in dims:
        pts = pts.filter(F.abs(d) < math.inf)  # nor NaN
    by_place = Window.partitionBy(*dims).orderBy("src")
    cands = cut(
        pts.withColumn("_rn", F.row_number().over(by_place)).filter(F.col("_rn") <= k + 1)
        .withColumnRenamed("src", "dst")
    )
    n = cands.count()
    if not n:
        return pts.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("d"), F.lit(1).alias("rank")).limit(0)
    tiles = min(MAX_TILES, -(-n // TILE_PLACES))
    sample = np.zeros((0, len(dims)))
    if tiles > 1:  # walls only; a tile holds every point inside them
        some = cands.filter((F.col("_rn") == 1) & (F.pmod(F.xxhash64(*dims), F.lit(max(1, n // (tiles * TILE_SAMPLE)))) == 0))
        table = some.select(*dims).toArrow()  # about MAX_TILES * TILE_SAMPLE rows at most
        sample = np.column_stack([table.column(d).to_numpy() for d in dims])
    placed, first, further = _nearest(k, dims, _tiles(sample, TILE_SAMPLE))
    kind = pts.schema["src"].dataType
    place = [T.StructField(d, T.DoubleType()) for d in dims]
    near = T.StructField("near", T.ArrayType(T.StructType([T.StructField("d", T.DoubleType()), T.StructField("dst", kind)])))
    met = T.StructField("_met", T.LongType())
    order = F.row_number().over(Window.partitionBy("_tile").orderBy("dst")).alias("_o")
    tiled = cands.mapInArrow(placed, T.StructType([*cands.schema.fields, T.StructField("_tile", T.IntegerType())]))
    own = T.StructType([*place, T.StructField("ids", T.ArrayType(kind)), near, met, T.StructField("_r", T.DoubleType()), T.StructField("_reach", T.ArrayType(T.IntegerType()))])
    here = cut(tiled.select("*", order).groupBy("_tile").applyInArrow(first, own))
    lists = here.filter(F.size("_reach") == 0).select(*dims, "ids", "near")
    asking = here.filter(F.size("_reach") > 0)
    told = [here]
    if not asking.isEmpty():
        asks = cut(asking.select(*dims, "_r", F.explode("_reach").alias("_tile")))
        parts = asks.groupBy("_tile").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("_ways"))
        more = F.broadcast(parts.filter("_ways > 1"))  # a row per TILE_ROWS asking places at most
        ways = F.coalesce("_ways", F.lit(1))
        one = asks.join(more, "_tile", "left").select(
            "_tile", F.pmod(F.xxhash64(*dims), ways).cast("int").alias("_part"), *dims, F.lit(None).cast(kind).alias("dst"), "_r")
        other = tiled.join(more, "_tile", "left").select(
            "_tile", F.explode(F.sequence(F.lit(0), ways - 1)).alias("_part"), *dims, "dst", F.lit(None).cast("double").alias("_r"))
        order = F.row_number().over(Window.partitionBy("_tile", "_part").orderBy("dst")).alias("_o")
        there = cut(one.unionByName(other).select("*", order).groupBy("_tile", "_part").applyInArrow(further, T.StructType([*place, near, met])))
        told.append(there)
        both = asking.select(*dims, "ids", "near").unionByName(there.select(*dims, "near"), allowMissingColumns=True)
        lists = lists.unionByName(cut(
            both.groupBy(*dims).agg(F.first("ids", ignorenulls=True).alias("ids"), F.flatten(F.collect_list("near")).alias("near"))
            .withColumn("near", F.slice(F.array_sort("near"), 1, k + 1))))
    if report is not None:
        report |= {"rounds": len(told), "pairs": sum(t.agg(F.sum("_met")).first()[0] or 0 for t in told)}

    others = F.slice(F.filter("near", lambda e: e["dst"] != F.col("src")), 1, k)
    full = lists.filter(F.size("ids") > k)
    out = lists.filter(F.size("ids") <= k).select(F.explode("ids").alias("src"), "near")
    if not here.filter(F.size("ids") > k).isEmpty():  # places that may hold more points than may be neighbours
        full = cut(full.join(pts.groupBy(*dims).agg(F.count("*").alias("_n")), dims).select(*dims, "near", "_n"))
        out = out.unionByName(hot_key_join(pts, full, dims, "_n").select("src", "near"))
    return (
        out.select("src", F.posexplode(others).alias("_pos", "_e"))
        .select("src", F.col("_e.dst").alias("dst"), F.col("_e.d").alias("d"), (F.col("_pos") + 1).alias("rank"))
    )


TILE_PLACES = 8192  # points of a tile, about
TILE_SAMPLE = 64  # places of a tile that tell its walls
MAX_TILES = 16_384


def _tiles(sample: np.ndarray, most: int) -> dict[str, np.ndarray]:
    """Space halved along the widest axis at the median of ``sample`` while a part holds more than ``most`` of its places.

    Nodes with their axis (-1: a tile), wall, children and tile; the walls of every tile. Any point lies in exactly one.
    """
    width = sample.shape[1]
    axes, walls, children, tile, low, high = [], [], [], [], [], []
    todo = [(sample, np.full(width, -np.inf), np.full(width, np.inf), None, 0)]
    while todo:
        x, lo, hi, parent, side = todo.pop()
        at, values = len(axes), np.zeros(0)
        if parent is not None:
            children[parent][side] = at
        if len(x) > most:
            axis = int(np.argmax(np.ptp(x, axis=0)))
            values = np.unique(x[:, axis])
        children.append([0, 0])
        if len(values) < 2:
            axes.append(-1), walls.append(0.0), tile.append(len(low)), low.append(lo), high.append(hi)
            continue
        wall = max(float(np.partition(x[:, axis], len(x) // 2)[len(x) // 2]), float(values[1]))
        axes.append(axis), walls.append(wall), tile.append(-1)
        below, above = hi.copy(), lo.copy()
        below[axis] = above[axis] = wall
        left = x[:, axis] < wall
        todo += [(x[left], lo, below, at, 0), (x[~left], above, hi, at, 1)]
    return {"axis": np.array(axes), "wall": np.array(walls), "child": np.array(children), "tile": np.array(tile), "low": np.array(low), "high": np.array(high)}


def _nearest(k: int, dims: Sequence[str], tree: dict[str, np.ndarray]):
    """Functions for tasks: the tile of a point, the search in the own tile, and in a tile that a ball meets."""
    dims, leaf, block = list(dims), max(LEAF_ROWS, 2 * (k + 1)), BLOCK_PAIRS

    def matrix(table) -> np.ndarray:
        return np.column_stack([table.column(d).to_numpy() for d in dims]) + 0.0  # no negative zeros

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch)
            node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
            while (inner := tree["axis"][node] >= 0).any():
                right = x[rows, np.maximum(tree["axis"][node], 0)] >= tree["wall"][node]
                node = np.where(inner, tree["child"][node, right.astype(np.int64)], node)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree["tile"][node], pa.int32())], [*batch.schema.names, "_tile"])

    def leaves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the points and starts of their leaves: halved along the widest axis down to ``leaf`` points."""
        parts, todo = [], [np.arange(len(x))]
        while todo:
            at = todo.pop()
            if len(at) <= leaf:
                parts.append(at)
                continue
            axis, half = int(np.argmax(np.ptp(x[at], axis=0))), len(at) // 2
            at = at[np.argpartition(x[at, axis], half)]
            todo += [at[half:], at[:half]]
        return np.concatenate(parts), np.cumsum([0, *(len(q) for q in parts)])

    def squares(p: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(p), len(x)))
        for axis in range(p.shape[1]):
            gap = p[:, axis, None] - x[:, axis]
            gap *= gap
            out += gap
        return out

    def apart(lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Distance of one box from many (or from points)."""
        return np.sqrt((np.maximum(0.0, np.maximum(lo - high, low - hi)) ** 2).sum(-1))

    def rounded(d: np.ndarray) -> np.ndarray:
        """Nine decimals, halves up, as the engine rounds: by the shortest decimal form of a number."""
        t = d * 1e9
        whole = np.floor(t)
        part = t - whole
        out = np.where(t < 2.0 ** 53, (whole + (part >= 0.5)) / 1e9, d)  # larger ones have no tenth decimal
        for i in np.flatnonzero((np.abs(part - 0.5) <= 1e-6 + t * 4e-16) & (t < 2.0 ** 53)):
            out[i] = float(Decimal(repr(float(d[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
        return out

    def wide(r: np.ndarray) -> np.ndarray:
        """A distance that nothing equal to ``r`` after rounding exceeds."""
        return r * (1 + 1e-12) + 2e-9

    def best(i: np.ndarray, j: np.ndarray, d: np.ndarray, code: np.ndarray):
        """The first k+1 of every place by distance, then id."""
        order = np.lexsort((code[j], d, i))
        i, j, d = i[order], j[order], d[order]
        start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
        keep = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)])) <= k
        return i[keep], j[keep], d[keep]

    def search(q: np.ndarray, limit: np.ndarray, x: np.ndarray, code: np.ndarray):
        """Up to k+1 points nearest to each place of ``q`` within ``limit``, sorted by place, and pairs compared by place."""
        found, pairs = [], np.zeros(len(q), np.int64)
        order, ends = leaves(x)
        x, code = x[order], code[order]
        low, high = np.minimum.reduceat(x, ends[:-1]), np.maximum.reduceat(x, ends[:-1])
        q_order, q_ends = leaves(q)
        for first, last in zip(q_ends[:-1], q_ends[1:]):
            rows = q_order[first:last]
            p = q[rows]
            lo, hi = p.min(0), p.max(0)
            close = int(np.argmin((((low + high) - (lo + hi)) ** 2).sum(1)))
            d2 = squares(p, x[ends[close]:ends[close + 1]])
            pairs[rows] += d2.shape[1]
            r = limit[rows]
            if d2.shape[1] > k:  # k+1 points bound the distance
                r = np.minimum(r, np.sqrt(np.partition(d2, k, axis=1)[:, k]))
            r = wide(r)
            most = r.max()
            hit = np.flatnonzero(apart(lo, hi, low, high) <= most)
            sizes = ends[hit + 1] - ends[hit]
            at = np.repeat(ends[hit] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            at = at[apart(lo, hi, x[at], x[at]) <= most]
            pairs[rows] += len(at)
            got = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            step, square = max(1, block // len(rows)), (r * r)[:, None]
            for begin in range(0, len(at), step):
                some = at[begin:begin + step]
                d2 = squares(p, x[some])
                i, j = np.nonzero(d2 <= square)
                new = (i, some[j], rounded(np.sqrt(d2[i, j])))
                got = best(*(np.concatenate([a, b]) for a, b in zip(got, new)), code)
            found.append((rows[got[0]], order[got[1]], got[2]))
        i, j, d = (np.concatenate([f[c] for f in found]) for c in range(3))
        by = np.argsort(i, kind="stable")
        return i[by], j[by], d[by], pairs

    def lists(i: np.ndarray, size: int, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(i, minlength=size))], pa.int32()), values)

    def pairs_of(ids: pa.Array, j: np.ndarray, d: np.ndarray) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(d), ids.take(pa.array(j))], ["d", "dst"])

    def first(table: pa.Table) -> pa.Table:
        tile = table.column("_tile")[0].as_py()
        x, rank = matrix(table), table.column("_rn").to_numpy()
        order = np.lexsort((rank, *x.T))  # points of one place together
        ids = table.column("dst").combine_chunks().take(pa.array(order))
        x, code = x[order], table.column("_o").to_numpy()[order]
        start = np.flatnonzero(rank[order] == 1)
        at = x[start]
        i, j, d, pairs = search(at, np.full(len(at), np.inf), x, code)
        r, counts = np.full(len(at), np.inf), np.bincount(i, minlength=len(at))
        enough = counts > k
        r[enough] = d[np.cumsum(counts)[enough] - 1]
        lo, hi = tree["low"][tile], tree["high"][tile]
        wall = np.minimum(at - lo, hi - at).min(1)
        crossing = np.flatnonzero(wall <= wide(r))
        to, tiles = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(crossing) and len(tree["low"]) > 1:
            by = apart(at[crossing].min(0), at[crossing].max(0), tree["low"], tree["high"]) <= wide(r[crossing]).max()
            by[tile] = False
            by = np.flatnonzero(by)
            step = max(1, block // max(1, len(by)))
            for begin in range(0, len(crossing), step):
                some = crossing[begin:begin + step]
                a, b = np.nonzero(apart(at[some, None], at[some, None], tree["low"][by], tree["high"][by]) <= wide(r[some])[:, None])
                to.append(some[a]), tiles.append(by[b])
        to, tiles = np.concatenate(to), np.concatenate(tiles)
        held = pa.ListArray.from_arrays(pa.array(np.r_[start, len(x)], pa.int32()), ids)
        return pa.table([
            *(pa.array(c) for c in at.T), held, lists(i, len(at), pairs_of(ids, j, d)), pa.array(pairs), pa.array(r), lists(to, len(at), pa.array(tiles, pa.int32()))
        ], names=[*dims, "ids", "near", "_met", "_r", "_reach"])

    def further(table: pa.Table) -> pa.Table:
        x, r = matrix(table), table.column("_r")
        asks = r.is_valid().to_numpy()
        here, q = np.flatnonzero(~asks), x[asks]
        ids = table.column("dst").combine_chunks().take(pa.array(here))
        i = j = np.zeros(0, np.int64)
        d, pairs = np.zeros(0), np.zeros(len(q), np.int64)
        if len(here) and len(q):
            i, j, d, pairs = search(q, r.to_numpy()[asks], x[here], table.column("_o").to_numpy()[here])
        return pa.table([*(pa.array(c) for c in q.T), lists(i, len(q), pairs_of(ids, j, d)), pa.array(pairs)], names=[*dims, "near", "_met"])

    return placed, first, further
