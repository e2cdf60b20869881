"""Ranked lexical search by branch and bound over a trie of documents.

Only terms that some item asks for matter, so a document is its restricted term vector: those terms in falling order of
document frequency, with their counts. Documents of a block, sorted by that sequence, form a frequency-ordered trie;
runs with a common beginning are its nodes. A node keeps, over the documents below it, each term's largest count and the
smallest length factor m. A score grows with counts and falls with m, so a node's values bound the score of every
document below, and at a document the bound is the score.

A search goes depth first, the most promising branch first, and enters a branch only for the items whose bound there
reaches their k-th score so far. All items of a block of items go down together, each leaving on its own account. Equal
documents are one leaf with its smallest ids: no more of them than ranks can be in a result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostrata.llm.common import ship, text_of
from geostrata.session import cut

# Terms are found on UTF-8 bytes: all bytes of characters above U+007F are above 0x7f. Others become spaces.
LETTERS = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256)).lower()
ITEMS_AT_ONCE = 2048
BLOCK_DOCS, BLOCK_ENTRIES = 8192, 1 << 20
LEAF = 8
SALTS = 64


def terms(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


@dataclass
class Asked:
    """A block of items: their distinct terms, and each item's terms as places in that list, repeats counted."""

    terms: list[bytes]
    starts: np.ndarray
    flat: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Asked:
        place: dict[bytes, int] = {}
        starts, flat, times = [0], [], []
        for text in texts:
            counts: dict[int, int] = {}
            for t in terms(text.encode("utf-8", "replace")):
                at = place.setdefault(t, len(place))
                counts[at] = counts.get(at, 0) + 1
            flat += counts
            times += counts.values()
            starts.append(len(flat))
        return cls(list(place), np.array(starts, np.int64), np.array(flat, np.int64), np.array(times, np.int64))


def gains(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class Node:
    lo: int
    hi: int
    children: list | None = None
    terms: np.ndarray | None = None
    counts: np.ndarray | None = None
    m: int = 0


class Trie:
    """The trie of one block: vectors ``(terms, counts)`` in falling document frequency, ``m``, and the ids of each.

    Equal vectors must have been merged. A node is ``(lo, hi, depth, children)`` over the sorted vectors; runs of at
    most ``LEAF`` documents are not parted further.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], m: np.ndarray, ids: list):
        order = sorted(range(len(vectors)), key=lambda i: vectors[i][0].astype(">u4").tobytes())
        self.vectors, self.m, self.ids = [vectors[i] for i in order], m[order], [ids[i] for i in order]
        self.shared = np.array([0] + [self._common(a[0], b[0]) for a, b in zip(self.vectors, self.vectors[1:])], np.int64)
        self.root = self._node(0, len(order))

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def _node(self, lo: int, hi: int) -> Node:
        """Built without recursion: a chain of rare beginnings may be long."""
        root, made = Node(lo, hi), []
        todo = [root]
        while todo:
            node = todo.pop()
            made.append(node)
            if node.hi - node.lo <= LEAF:
                continue
            inside = self.shared[node.lo + 1:node.hi]
            cuts = [node.lo, *(np.flatnonzero(inside == inside.min()) + node.lo + 1).tolist(), node.hi]
            node.children = [Node(a, b) for a, b in zip(cuts, cuts[1:])]
            todo += node.children
        for node in reversed(made):  # children before their parents
            if node.children:
                parts = [(c.terms, c.counts) for c in node.children]
                node.m = min(c.m for c in node.children)
            else:
                parts = self.vectors[node.lo:node.hi]
                node.m = int(self.m[node.lo:node.hi].min())
            node.terms, node.counts = _most(parts)
        return root


def _most(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    terms_, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(terms_, kind="stable")
    terms_, counts = terms_[order], counts[order]
    first = np.flatnonzero(np.diff(terms_, prepend=-1))
    return (terms_[first], np.maximum.reduceat(counts, first)) if len(first) else (terms_, counts)


class Search:
    """The best ``k`` documents of each item so far; ``weights`` by term, in the order of document frequency."""

    def __init__(self, asked: Asked, weights: np.ndarray, k: int):
        self.k, self.n = k, len(asked.starts) - 1
        self.starts, self.flat, self.factor = asked.starts, asked.flat, asked.times * weights[asked.flat]
        self.best: list[list] = [[] for _ in range(self.n)]  # heaps of (score, -place in order of ids, id)
        self.floor = np.ones(self.n, np.int64)  # a score below never enters
        self.values = np.zeros(len(weights), np.int64)

    def _of(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = self.starts[items + 1] - self.starts[items]
        edges = np.cumsum(sizes) - sizes
        at = np.repeat(self.starts[items] - edges, sizes) + np.arange(sizes.sum())
        return self.flat[at], self.factor[at], edges

    def _scores(self, terms_: np.ndarray, counts: np.ndarray, m: int, flat: np.ndarray, factor: np.ndarray, edges: np.ndarray) -> np.ndarray:
        self.values[terms_] = gains(counts, m)
        out = np.add.reduceat(factor * self.values[flat], edges)
        self.values[terms_] = 0
        return out

    def _offer(self, items: np.ndarray, scores: np.ndarray, ids: list) -> None:
        for item, score in zip(items[scores >= self.floor[items]].tolist(), scores[scores >= self.floor[items]].tolist()):
            heap = self.best[item]
            for name in ids:
                entry = (score, Later(name))
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif heap[0] < entry:
                    heapq.heapreplace(heap, entry)
                else:
                    break  # ids come in order
            if len(heap) == self.k:
                self.floor[item] = heap[0][0]

    def run(self, trie: Trie) -> None:
        every = np.flatnonzero(self.starts[1:] > self.starts[:-1])
        todo = [(trie.root, every)] if len(every) else []
        while todo:
            node, items = todo.pop()
            flat, factor, edges = self._of(items)
            bound = self._scores(node.terms, node.counts, node.m, flat, factor, edges)
            items = items[bound >= self.floor[items]]
            if not len(items):
                continue
            flat, factor, edges = self._of(items)
            if node.children is None:
                for i in range(node.lo, node.hi):
                    self._offer(items, self._scores(*trie.vectors[i], int(trie.m[i]), flat, factor, edges), trie.ids[i])
                continue
            ahead = [(int(self._scores(c.terms, c.counts, c.m, flat, factor, edges).max()), j) for j, c in enumerate(node.children)]
            todo += [(node.children[j], items) for _, j in sorted(ahead)]  # the last is entered first


class Later:
    """An id in reverse order, nulls the latest, so that of equal scores the heap gives up the largest id first."""

    __slots__ = ("name",)

    def __init__(self, name):
        self.name = name

    def __lt__(self, other: Later) -> bool:
        if self.name is None or other.name is None:
            return self.name is None and other.name is not None
        return self.name > other.name

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Later) and self.name == other.name


def _vectors(asked: list[bytes]):
    """Length and restricted term vector of each document: places in ``asked`` and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(asked)}
        for batch in batches:
            lengths, owner, at, counts = [], [0], [], []
            for text in batch.column(1):
                words = terms(text.as_py())
                found: dict[int, int] = {}
                for i in map(place.get, words):
                    if i is not None:
                        found[i] = found.get(i, 0) + 1
                lengths.append(len(words))
                at += found
                counts += found.values()
                owner.append(len(at))
            edges = pa.array(owner, pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(x, kind)) for x, kind in ((at, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return run


def _searched(asked: Asked, weights: np.ndarray, rank: np.ndarray, total: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Asked(asked.terms, asked.starts, rank[asked.flat], asked.times)
        by_rank = np.empty_like(weights)
        by_rank[rank] = weights
        search, held, entries = Search(own, by_rank, k), {}, 0

        def finish() -> None:
            if not held:
                return
            keys = list(held)
            vectors = [(np.frombuffer(t, np.int64), np.frombuffer(c, np.int64)) for t, c, _ in keys]
            ids = [sorted(held[key], key=lambda x: (x is None, x))[:k] for key in keys]
            search.run(Trie(vectors, np.array([m for *_, m in keys], np.int64), ids))
            held.clear()

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for name, n, t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                seq, counts = rank[t.values.to_numpy()], c.values.to_numpy()
                order = np.argsort(seq)
                key = (seq[order].tobytes(), counts[order].tobytes(), 25 + 75 * n * total // length)
                ids = held.get(key)
                if ids is None:
                    held[key] = [name]
                    entries += len(seq)
                    if len(held) >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                        finish()
                        entries = 0
                else:
                    ids.append(name)
                    if len(ids) > 4 * k:
                        held[key] = sorted(ids, key=lambda x: (x is None, x))[:k]
        finish()
        rows = [(i, e[1].name, e[0]) for i, heap in enumerate(search.best) for e in heap]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())],
                ["item", "doc_id", "score"])

    return run


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(texts: list[str], docs: DataFrame, k: int) -> DataFrame:
    """``(text, rank, doc_id, score)`` of the best documents of each text."""
    spark, asked = docs.sparkSession, Asked.of(texts)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of().cast("binary").alias("text"))
    vectors = cut(rows.mapInArrow(_vectors(asked.terms), f"doc_id {kind}, n long, terms array<int>, counts array<long>").where("n > 0"))
    total, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(asked.terms), np.int64)
    for t, n in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per asked term of the block
        df[t] = n
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    rank = np.empty(len(df), np.int64)
    rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    found = vectors.where(F.size("terms") > 0).select("doc_id", "n", "terms", "counts").mapInArrow(
        _searched(asked, weights, rank, total, length, k), f"item int, doc_id {kind}, score long")
    part = _best(found.withColumn("salt", F.spark_partition_id() % SALTS), ["item", "salt"], k).drop("rank", "salt")
    names = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item int, text string")
    return _best(part, ["item"], k).join(F.broadcast(names), "item").select("text", "rank", "doc_id", "score")  # ITEMS_AT_ONCE rows


def search(items: DataFrame, docs: DataFrame, k: int = 10, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` best documents of positive score, ties by ascending id.

    Terms are runs of letters and digits, A-Z lower-cased; characters above U+007F are letters. Items come in blocks of
    about ``at_once`` distinct texts, and each block reads the documents once; only a block's texts pass the driver.
    A null text has no terms, so it finds nothing and is not found. Null document ids rank last among equal scores;
    rows of one id are documents of their own; repeated items each get their rows. Other columns are not read. An empty
    table gives no rows.
    """
    ship(docs.sparkSession)
    asked = cut(items.select("item_id", text_of().alias("text")))
    texts = cut(asked.select("text").distinct())
    blocks = max(1, math.ceil(texts.count() / at_once))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = None
    for i in range(blocks):
        block = [r.text for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i).collect()]
        part = cut(_search_block(sorted(block), docs, k)) if block else None
        found = part if found is None else found if part is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], f"text string, rank int, doc_id {kind}, score long")
    return asked.join(found, "text").select("item_id", "rank", "doc_id", "score")

