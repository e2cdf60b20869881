"""Near-duplicates by SimHash, found through Golay-code fuzzy hashing.

The 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Two fingerprints with at most two differing
bits agree in at least one segment (three segments, two errors), and in every other segment they differ in at
most two bits. The binary Golay code (23, 12) is perfect: every 23-bit word lies within three bits of exactly one
codeword, and two words at most two bits apart always have a common codeword within four bits. A word has one
codeword that near, or six when its nearest is three bits away. So a fingerprint gets keys

    (which segment, its exact bits, index of one near codeword of the next segment)

and every linked pair shares a key. Pairs under a key are verified on all 64 bits.

A key with more than ``crowd`` fingerprints is not paired out: its members are also keyed by every word one bit
away. Two of them within two bits meet at the word between them, where at most 65 fingerprints can meet, all of
them linked. Copies are one fingerprint throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geostrata.llm import shingle_sets
from geostrata.llm.common import components, mapped, ship, text_of
from geostrata.session import cut

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
WORD_BITS, CHECK_BITS = 23, 11
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit, bits
SEED = 42
CHUNK = 65_536


def fingerprint(text: str, size: int = 3) -> int:
    """64 bits: bit i is set when more than half of the shingles' hashes set it; no words give zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(line)]
    if len(words) < size:
        starts, ends = [0], [len(line)]
    else:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1:]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts)))


def majority(hashes: np.ndarray) -> int:
    """Bit i is set when it is in more than half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at:at + CHUNK].astype("<u8", copy=False)
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp long)`` of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks)], ["doc_id", "fp"])

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", text_of().alias("text")), run, f"doc_id {kind}, fp long")


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials by the generator."""
    out, power = np.zeros_like(words), 1
    for bit in range(WORD_BITS):
        out ^= ((words >> bit) & 1) * power
        power <<= 1
        if power >> CHECK_BITS:
            power ^= GENERATOR
    return out


@lru_cache(maxsize=1)
def near_errors() -> np.ndarray:
    """By syndrome, the error words of weight four at most: one, or one of weight three and five of weight four (else -1)."""
    found = [[] for _ in range(1 << CHECK_BITS)]
    for weight in range(5):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(WORD_BITS), weight)], np.int64)
        for error, s in zip(errors.tolist(), syndromes(errors).tolist()):
            found[s].append(error)
    return np.array([x + [-1] * (6 - len(x)) for x in found], np.int64)


def golay_keys(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the fingerprint and key, for every key of every fingerprint."""
    words = [(marks.astype(np.uint64) >> np.uint64(a)).astype(np.int64) & ((1 << n) - 1) for a, n in SEGMENTS]
    owners, keys = [], []
    for i, exact in enumerate(words):
        other = words[(i + 1) % len(words)]
        errors = near_errors()[syndromes(other)]
        row, col = np.nonzero(errors >= 0)
        index = (other[row] ^ errors[row, col]) >> CHECK_BITS  # a codeword's upper 12 bits name it
        owners.append(row)
        keys.append((i << 40) | (exact[row] << 12) | index)
    return np.concatenate(owners), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = batch.column(0).to_numpy(zero_copy_only=False)
        owner, key = golay_keys(marks.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(marks[owner]), pa.array(key)], ["fp", "key"])


def linked(marks: DataFrame, crowd: int = 64) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``(fp)`` of at most two differing bits, enough to keep every
    pair connected: verified pairs under ordinary keys, chains of mutually linked ones under crowded keys."""
    ship(marks.sparkSession)
    keys = cut(mapped(marks.select("fp"), _keyed, "fp long, key long"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keys.join(sizes, "key"))
    few = shared.where(F.col("n") <= crowd)
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(v).cast("long") for v in (np.uint64(1) << np.arange(64, dtype=np.uint64)).view(np.int64).tolist()])
    middles = shared.where(F.col("n") > crowd).select("fp").distinct().select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    met = middles.groupBy("middle").agg(F.sort_array(F.collect_list("fp")).alias("all")).where(F.size("all") > 1)
    chains = met.select(F.explode(F.arrays_zip(F.slice("all", F.lit(1), F.size("all") - 1).alias("a"), F.slice("all", 2, F.size("all") - 1).alias("b"))).alias("p")).select("p.a", "p.b")
    return pairs.union(chains).distinct()


def near_duplicates(docs: DataFrame, crowd: int = 64) -> DataFrame:
    """``(doc_id, fp, component_id, group_fp)`` for every row: the smallest id and fingerprint reachable over links.

    Rows of equal fingerprint are linked, also those without words (fingerprint zero). A null id is never the
    smallest unless its whole component has no other. Repeated rows each give a row. Only ``doc_id`` and ``text``
    are read. An empty table gives no rows.
    """
    rows = cut(fingerprints(docs))
    marks = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    group = components(linked(marks, crowd))
    whole = marks.join(group.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("group_fp"))
    roots = whole.groupBy("group_fp").agg(F.min("first").alias("component_id"))
    named = whole.join(roots, "group_fp").select("fp", "component_id", "group_fp")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "group_fp")


def keep_one(docs: DataFrame, crowd: int = 64, broadcast_rows: int = 500_000, size: int | None = None, least: float = 0.8) -> DataFrame:
    """One row of every group: the row whose id is the group's smallest (of several such rows the smallest row).

    Groups are those of ``near_duplicates``; with ``size``, those of texts whose shingles of that many words have a
    Jaccard similarity of ``least`` or more. The ids to drop are broadcast while they number at most
    ``broadcast_rows``; beyond that the join shuffles.
    """
    groups = cut(near_duplicates(docs, crowd) if size is None else shingle_sets.near_duplicates(docs, size, least, crowd, broadcast_rows))
    best = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and(best).alias("best"))
    out = cut(ids.where("n > 1 OR NOT best").select(F.col("doc_id").alias("id"), (F.col("n") > 1).alias("several")))
    total, several = out.agg(F.count("*"), F.count_if("several")).first()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = F.col("row.doc_id").eqNullSafe(F.col("id"))
    single = rows.join(F.broadcast(out) if total <= broadcast_rows else out, own, "left_anti")
    if not several:
        return single.select("row.*")
    # ids that stand in several rows do not tell which row is meant; these rows are told apart by fingerprint
    again = rows.join(out.where("several"), own, "left_semi").select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "row")
    chosen = groups.where(best).select("doc_id", "fp", "group_fp").distinct()
    marked = _with_rows(again, size).alias("m").join(chosen.alias("c"), F.col("m.row.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("m.fp") == F.col("c.fp")))
    first = marked.groupBy("c.group_fp").agg(F.min("m.row").alias("row")).select("row")
    return single.union(first).select("row.*")


def _with_rows(rows: DataFrame, size: int | None = None) -> DataFrame:
    """``(row, fp)`` of rows ``(doc_id, text, row)``."""
    kind = T.StructType([rows.schema["row"], T.StructField("fp", T.LongType())])

    def name(text: str) -> int:
        return int(np.uint64(fingerprint(text)).view(np.int64)) if size is None else shingle_sets.mark(shingle_sets.shingles(text, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([name(t.as_py()) for t in batch.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1), marks], ["row", "fp"])

    return mapped(rows.select(text_of().alias("text"), "row"), run, kind)
