"""Exact top-k inner-product search by distributed histogram selection.

Vectors are quantised to integers, so scores are integers. Queries and candidates lie in blocks; a task scores one
block of queries against one block of candidates. In every round each query's scores are counted by their next
digits (a global histogram per query, summed over the candidate blocks), which locates its k-th value more closely;
after the last round the k-th value is known exactly. A last pass returns what lies above and, at the k-th value,
the smallest ids.

A block reports its histogram from the top down to its own k-th value only: the global k-th value cannot be lower.
For the same reason it returns at the k-th value no more ids than are still wanted. Scores are never stored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.llm.common import ship
from geostrata.session import cut

SCALE = 64
ROWS_AT_ONCE = 2_000_000  # scores held by a task


def usable(column: str) -> Column:
    """Not null and without null or non-finite components."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)`` of the usable vectors: floor(scale * x) of every component, x as double."""
    whole = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(usable("embedding")).select("vec_id", whole.alias("v"))


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floats are used while every sum fits into their 53 bits."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (q.astype(kind) @ c.astype(kind).T).astype(np.int64)


@dataclass
class _Blocks:
    queries: DataFrame  # dim, qb, query_id, v
    candidates: DataFrame  # dim, cb, vec_id, v
    n_q: int
    n_c: int

    def met(self, state: DataFrame, run, schema: str) -> DataFrame:
        """Every query block with its state against every candidate block."""
        left = self.queries.join(state, ["dim", "query_id"]).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(self.n_c - 1))))
        right = self.candidates.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(self.n_q - 1))))
        by = ["dim", "qb", "cb"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)


def _slices(left: pa.Table, right: pa.Table):
    """Query rows in slices of bounded size: where they are, and their scores (own id: excluded)."""
    if not left.num_rows or not right.num_rows:
        return
    q, c = matrix(left["v"], left.num_rows), matrix(right["v"], right.num_rows)
    ids, own = right["vec_id"].to_numpy(), left["query_id"].to_numpy()
    step = max(1, ROWS_AT_ONCE // len(c))
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        yield part, _products(q[part], c), own[part, None] == ids[None, :]


def _counter(bound: int, shift: int, bits: int):
    """Digits of the shifted scores of those that share the query's prefix, counted from the top."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        for part, scores, same in _slices(left, right):
            prefix, need = (left[x].to_numpy()[part] for x in ("prefix", "need"))
            level = (scores + bound) >> shift
            inside = ((level >> bits) == prefix[:, None]) & ~same
            row, col = np.nonzero(inside)
            digit = level[row, col] & ((1 << bits) - 1)
            counts = np.bincount((row << bits) | digit, minlength=len(prefix) << bits).reshape(len(prefix), -1)[:, ::-1]
            before = np.cumsum(counts, 1) - counts
            r, d = np.nonzero((counts > 0) & (before < need[:, None]))
            out[0].append(left["query_id"].to_numpy()[part][r])
            out[1].append((1 << bits) - 1 - d)
            out[2].append(counts[r, d])
        cols = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
        return pa.table({"query_id": cols[0], "digit": cols[1], "n": cols[2]})

    return run


def _picker(bound: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        ids = right["vec_id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        for part, scores, same in _slices(left, right):
            prefix, need = (left[x].to_numpy()[part] for x in ("prefix", "need"))
            scores, same = scores[:, by_id], same[:, by_id]
            kth = (prefix - bound)[:, None]
            level = (scores == kth) & ~same
            first = level & (np.cumsum(level, 1) <= need[:, None])
            r, c = np.nonzero(((scores > kth) & ~same) | first)
            out[0].append(left["query_id"].to_numpy()[part][r])
            out[1].append(ids[by_id][c])
            out[2].append(scores[r, c])
        cols = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    return run


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: int = SCALE, query_rows: int = 2048,
    block_rows: int = 8192, bits: int = 7,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k highest scores among all other ids, ties to smaller ids.

    ``vectors`` has ``vec_id`` (an integer) and ``embedding``. Vectors that are null or hold null or non-finite
    components take no part, nor do rows without an id; vectors are compared with those of their own length. A
    query id that stands in several rows is searched once, with its smallest vector; as candidates all rows count.
    Fewer candidates than k give them all, none give no rows. Scores must fit into 64 bits.
    """
    spark = vectors.sparkSession
    ship(spark)
    ready = quantised(vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), scale)
    ready = cut(ready.withColumn("dim", F.size("v")))
    asked = ready.where(is_query).groupBy(F.col("vec_id").alias("query_id"), "dim").agg(F.min("v").alias("v"))
    asked = asked.withColumn("shortest", F.min("dim").over(Window.partitionBy("query_id"))).where("dim = shortest").drop("shortest")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    n_rows, top = ready.agg(F.count("*"), F.max(norm)).first()
    n_asked = asked.count()
    bound = int(math.ceil((top or 0.0) ** 2 * (1 + 1e-9))) + 1  # no inner product is larger
    n_q, n_c = max(1, math.ceil(n_asked / query_rows)), max(1, math.ceil(n_rows / block_rows))
    blocks = _Blocks(
        cut(asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int"))),
        cut(ready.withColumn("cb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_c)).cast("int"))), n_q, n_c)
    left = (2 * bound).bit_length()
    rounds = max(1, math.ceil(left / bits))
    state = blocks.queries.select("dim", "query_id", F.lit(0).cast("long").alias("prefix"), F.lit(k).cast("long").alias("need"))
    for i in range(rounds):
        shift = bits * (rounds - 1 - i)
        seen = blocks.met(state, _counter(bound, shift, bits), "query_id long, digit long, n long")
        seen = seen.groupBy("query_id", "digit").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.col("digit").desc())
        upto = seen.withColumn("upto", F.sum("n").over(down)).join(state, "query_id")
        at = F.coalesce(F.max(F.when(F.col("upto") >= F.col("need"), F.struct("digit", "upto", "n"))), F.min(F.struct("digit", "upto", "n")))
        found = upto.groupBy("query_id", "dim", "prefix", "need").agg(at.alias("at"))
        state = cut(found.select(
            "dim", "query_id", (F.shiftleft("prefix", bits) + F.col("at.digit")).alias("prefix"),
            (F.col("need") - (F.col("at.upto") - F.col("at.n"))).alias("need")))
    best = blocks.met(state, _picker(bound), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
