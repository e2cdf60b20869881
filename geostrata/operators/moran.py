"""Global Moran's I, its inference and its scatter table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.functions.columns import ratio
from geostrata.functions.tails import normal_two_sided
from geostrata.operators.skew import spread_join
from geostrata.operators.distance import knn_edges
from geostrata.operators.weights import row_standardised, spatial_lag, weight_moments
from geostrata.session import cut


def centred(nodes: DataFrame, value: str, node: str = "id") -> DataFrame:
    """``(id, z)`` with the mean taken off; the mean is one number on the driver."""
    mean = nodes.agg(F.avg(value)).first()[0]
    return nodes.select(F.col(node).alias("id"), (F.col(value) - F.lit(mean or 0.0)).alias("z"))


def moran(nodes: DataFrame, weights: DataFrame, value: str, node: str = "id") -> DataFrame:
    """One row ``(n, moran_i)``: z'Wz / z'z for row-standardised weights, null for a constant."""
    z = spatial_lag(centred(nodes, value, node), weights, {"wz": "z"})
    return z.agg(
        F.count("*").alias("n"),
        ratio(F.sum(F.col("z") * F.col("wz")), F.sum(F.col("z") * F.col("z"))).alias("moran_i"),
    )


def moran_scatter(nodes: DataFrame, weights: DataFrame, value: str, node: str = "id") -> DataFrame:
    """Value, lag and the quadrant of both around their means."""
    lagged = spatial_lag(nodes.select(F.col(node).alias("id"), F.col(value).alias("x")), weights, {"wx": "x"})
    means = lagged.agg(F.avg("x"), F.avg("wx")).first()
    hi_x, hi_w = F.col("x") >= F.lit(means[0]), F.col("wx") >= F.lit(means[1])
    quadrant = (
        F.when(hi_x & hi_w, "HH").when(~hi_x & ~hi_w, "LL").when(hi_x, "HL").otherwise("LH")
    )
    return lagged.select("id", "x", "wx", quadrant.alias("quadrant"))


def moran_inference(nodes: DataFrame, weights: DataFrame, value: str, node: str = "id") -> DataFrame:
    """Expectation, variance under normality and randomisation, z and two-sided p."""
    z = cut(spatial_lag(centred(nodes, value, node), weights, {"wz": "z"}))
    m = z.agg(
        F.count("*").alias("n"), F.sum(F.pow("z", F.lit(2))).alias("m2"),
        F.sum(F.pow("z", F.lit(4))).alias("m4"), F.sum(F.col("z") * F.col("wz")).alias("zwz"),
    ).first()
    w = weight_moments(weights).first()
    return nodes.sparkSession.createDataFrame([_inference(m, w)], _INFERENCE)


_INFERENCE = (
    "n long, moran_i double, e_i double, var_norm double, z_norm double, p_norm double, "
    "var_rand double, z_rand double, p_rand double"
)


def _inference(m, w):
    n, s0, s1, s2 = m["n"], w["s0"], w["s1"], w["s2"]
    if not m["m2"] or n < 4 or not s0:
        return (n,) + (None,) * 8
    i = n / s0 * m["zwz"] / m["m2"]
    e = -1.0 / (n - 1)
    v_norm = (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - e * e
    kurt = n * m["m4"] / m["m2"] ** 2
    top = n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0)
    top -= kurt * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)
    v_rand = top / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - e * e
    out = [n, i, e]
    for v in (v_norm, v_rand):
        zed = (i - e) / math.sqrt(v) if v > 0 else None
        out += [v, zed, normal_two_sided(zed) if zed is not None else None]
    return tuple(out)


PRIME, SPREAD = (1 << 31) - 1, 48_271
KEYS = (7_919, 104_729, 15_485_863)  # by replicate, round and seed
ROUNDS = 4
BROADCAST_NODES = 8_000_000  # 64 MB of values in every task
BLOCK = 65_536  # ranks that a task maps at a time
AT_ONCE = 64  # replicates that travel together beyond that


def bijection(n: int, seed: int = 0):
    """``slots(ranks, replicate)``: where each rank 0 .. n-1 goes, a different one-to-one map for every replicate.

    A rank is a pair of digits (base a, base b, with a * b just above n); each round moves one digit by a keyed function
    of the other, which can be undone, so all pairs are met once. What leaves 0 .. n-1 goes through again until it
    is inside. The map is plain arithmetic below 2**62 and the same in every engine. The keyed functions are tabulated for
    the digits, about sqrt(n) of them.
    """
    a = math.isqrt(max(n - 1, 0)) + 1
    b = -(-n // a)
    prime, spread, keys, rounds = PRIME, SPREAD, KEYS, ROUNDS

    def moved(x, key):
        t = (x * spread + key) % prime
        return ((t * t) % prime * t + key) % prime

    def slots(ranks: np.ndarray, replicate: int) -> np.ndarray:
        moves = []  # what a digit adds to the other one, by round
        for q in range(rounds):
            key = (replicate * keys[0] + q * keys[1] + seed * keys[2] + 1) * spread % prime
            moves.append(moved(np.arange((b, a)[q % 2]), key) % (a, b)[q % 2])
        out, todo, now = np.empty(len(ranks), np.int64), None, ranks.astype(np.int64)
        while len(now):
            left, right = np.divmod(now, b)
            for q in range(rounds):
                digit, other, base = (left, right, a) if q % 2 == 0 else (right, left, b)
                digit += moves[q][other]
                np.subtract(digit, base, out=digit, where=digit >= base)
            now = left * b + right
            if todo is None:
                out[:] = now
            else:
                out[todo] = now
            beyond = np.flatnonzero(now >= n)
            todo, now = beyond if todo is None else todo[beyond], now[beyond]
        return out

    return slots


def in_order(df: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """Consecutive numbers from 0 in the order of ``key``: the number in the own range and the sizes of ranges before."""
    placed = cut(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = sorted(placed.groupBy(part.alias("p")).count().collect())  # a row per range
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    table = df.sparkSession.createDataFrame(starts, "_p long, _start long")
    return placed.join(F.broadcast(table), part == F.col("_p")).withColumn(name, F.col("_start") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_start")


def moran_permutation(
    nodes: DataFrame, weights: DataFrame, value: str, node: str = "id",
    permutations: int = 199, seed: int = 0, min_nodes: int = 3, broadcast_nodes: int = BROADCAST_NODES,
) -> DataFrame:
    """One-sided permutation p: ``(#{I* >= I} + 1) / (R + 1)``.

    Replicate r gives the value of the node with rank k (by id) to the node with rank ``bijection(k, r)``, so no replicate
    is drawn, sorted or stored. Edges carry the ranks of their ends and are read once; up to ``broadcast_nodes`` values
    go to every task, which reorders them in memory and adds up its edges. Beyond that the reordered values travel as
    arrays of ``AT_ONCE`` replicates per node.
    """
    z = centred(nodes.filter(F.col(value).isNotNull()), value, node)
    schema = "n long, moran_i double, p_value double, permutations long"
    ranked = cut(in_order(z, "id"))
    n = ranked.count()
    if n < min_nodes:
        return nodes.sparkSession.createDataFrame([(n, None, None, permutations)], schema)
    square = ranked.agg(F.sum(F.pow("z", F.lit(2)))).first()[0]
    indegree = weights.groupBy("dst").agg(F.count("*").alias("_n"))
    here = ranked.select("id", "rank")
    ends = spread_join(weights.select("src", "dst", "w"), here.select(F.col("id").alias("dst"), F.col("rank").alias("_d")), ["dst"], indegree, "_n")
    ends = ends.join(here.select(F.col("id").alias("src"), F.col("rank").alias("_s")), "src").select("_s", "_d", F.col("w").cast("double").alias("w"))
    sums = _by_task(ends, ranked, n, permutations, seed) if n <= broadcast_nodes else _by_shuffle(cut(ends), ranked, n, permutations, seed)
    got = dict(sums.collect())  # a row per replicate
    if not square or 0 not in got:
        return nodes.sparkSession.createDataFrame([(n, None, None, permutations)], schema)
    observed = got.pop(0) / square
    as_high = sum(v / square >= observed - 1e-12 for v in got.values())
    return nodes.sparkSession.createDataFrame([(n, observed, (as_high + 1) / (permutations + 1), permutations)], schema)


def _by_task(ends: DataFrame, ranked: DataFrame, n: int, permutations: int, seed: int) -> DataFrame:
    """``(r, t)``: the sum over edges of w z_src z_dst for the values as they are (r = 0) and every replicate."""
    spark, slots, block = ends.sparkSession, bijection(n, seed), BLOCK
    table = ranked.select("rank", "z").toArrow()  # at most broadcast_nodes rows
    values = np.empty(n)
    values[table.column("rank").to_numpy()] = table.column("z").to_numpy()
    shared = spark.sparkContext.broadcast(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, sums, held, rows = shared.value, np.zeros(permutations + 1), [], 0

        def add() -> None:
            s, d, w = (np.concatenate([b[i] for b in held]) for i in range(3))
            held.clear()
            now = np.empty(n)
            for r in range(permutations + 1):
                for at in range(0, n, block):
                    ranks = np.arange(at, min(at + block, n))
                    now[slots(ranks, r) if r else ranks] = z[at:at + block]
                sums[r] += float(np.sum(w * now[s] * now[d]))

        for batch in batches:
            held.append([batch.column(i).to_numpy().astype(t) for i, t in enumerate((np.int32, np.int32, np.float64))])
            rows += batch.num_rows
            if rows >= max(1_000_000, n):  # all values are reordered for as many edges at least, or once a task
                add()
                rows = 0
        if held:
            add()
            yield pa.RecordBatch.from_arrays([pa.array(range(permutations + 1), pa.int32()), pa.array(sums)], ["r", "t"])

    return ends.mapInArrow(run, "r int, t double").groupBy("r").agg(F.sum("t").alias("t"))


def _by_shuffle(ends: DataFrame, ranked: DataFrame, n: int, permutations: int, seed: int) -> DataFrame:
    """As ``_by_task``, with the values of ``AT_ONCE`` replicates at a time as an array at each node."""
    slots, out = bijection(n, seed), None

    for first in range(0, permutations + 1, AT_ONCE):
        block = list(range(first, min(first + AT_ONCE, permutations + 1)))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k, z = batch.column(0).to_numpy(), batch.column(1)
                for r in block:
                    yield pa.RecordBatch.from_arrays([pa.array(slots(k, r) if r else k), pa.array([r] * len(k), pa.int32()), z], ["slot", "r", "z"])

        drawn = ranked.select("rank", "z").mapInArrow(run, "slot long, r int, z double")
        zs = cut(drawn.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("r", "z"))).alias("a")).select("slot", F.col("a.z").alias("zs")))
        met = ends.join(zs.select(F.col("slot").alias("_s"), "zs"), "_s").join(zs.select(F.col("slot").alias("_d"), F.col("zs").alias("zd")), "_d")
        products = F.zip_with("zs", "zd", lambda x, y: x * y * F.col("w"))
        part = cut(met.select(F.posexplode(products).alias("r", "t")).groupBy("r").agg(F.sum("t").alias("t")))
        part = part.select((F.col("r") + first).alias("r"), "t")
        out = part if out is None else out.union(part)
    return out


def robustness(points: DataFrame, lat: str, lng: str, value: str, decimals=(1, 2), ks=(4, 8)) -> DataFrame:
    """Moran's I of rounded-grid means for several grids and neighbour numbers, with a verdict.

    Grid coordinates are whole numbers of grid steps, so equal distances tie exactly.
    """
    data = points.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull() & F.col(value).isNotNull())
    out = None
    for dec in decimals:
        step = 10 ** dec
        y, x = F.rint(F.col(lat) * step), F.rint(F.col(lng) * step)
        cells = cut(
            data.groupBy(y.alias("gy"), x.alias("gx")).agg(F.avg(value).alias("v"))
            .withColumn("id", ((F.col("gy") + 100_000) * 1_000_000 + F.col("gx") + 100_000).cast("long"))
        )
        edges = cut(knn_edges(cells, max(ks), "id", "gy", "gx"))
        for k in ks:
            w = row_standardised(edges.filter(F.col("rank") <= k).select("src", "dst"))
            row = moran(cells, w, "v").select(F.lit(dec).alias("decimals"), F.lit(k).alias("k"), "moran_i")
            out = row if out is None else out.unionByName(row)
    got = cut(out)
    lo, hi = got.agg(F.min("moran_i"), F.max("moran_i")).first()
    flips = lo is not None and lo < 0 < hi
    level = "danger" if flips else "warn" if lo is not None and hi - lo > 0.1 else "ok"
    return got.withColumn("level", F.lit(level))
