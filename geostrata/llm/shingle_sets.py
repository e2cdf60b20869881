"""Near-duplicates by the shingles they share: Jaccard similarity of the sets of word shingles.

Candidates come from SimHash first: fingerprints over the same shingles, linked at two differing bits or fewer through keys
of exact segments and Golay codewords (``simhash.linked``). Sets whose fingerprints hang together share a key.
At a similarity of 0.8 two fingerprints differ in ten bits on average and often in fifteen, where those keys
select nothing. So more candidates come from min-wise hashes: ``BANDS`` keys of
``ROWS`` minima each; a pair of similarity 0.8 shares none of them with probability 0.00007, a more similar one with
less. Candidates are verified on their whole shingle sets, so every link is a true one. Equal sets are one node.

No key is paired out while fewer pairs decide. First come the keys with more than ``crowd`` sets (below). Then every set
of another key is compared with the key's smallest set, and only sets of a key that are still in different groups are
compared with each other; so a group of n near copies costs n comparisons a key, and links are those of all pairs up to
what connects the same sets.

Sets that hang together by keys of more than ``crowd`` sets form one crowd, dealt into blocks by hash. Each block is compared with itself and with the next one; then the sets that are not yet in the
crowd's largest group are compared with all of the crowd. A pair that neither step compares lies inside that group,
so the groups are those of comparing all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm import simhash
from geostrata.llm.common import components, mapped, ship, text_of
from geostrata.operators.skew import hot_key_join
from geostrata.session import cut

BANDS, ROWS = 24, 5
SEED = 42
CHUNK = 4096
BLOCK_SETS, BLOCK_SHINGLES = 512, 262_144
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashes(text: str, size: int = 5) -> np.ndarray:
    """Hashes of ``size`` successive words, repeats included; of all words where there are fewer; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # as in simhash.fingerprint
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    last = max(1, len(words) - size + 1)
    return np.fromiter((digest(b" ".join(words[i:i + size]), SEED) for i in range(last)), np.uint64, last)


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct ``hashes``."""
    return np.unique(hashes(text, size))


def mark(found: np.ndarray) -> int:
    """A signed 64-bit name of the set; zero for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64)) if len(found) else 0


def band_keys(found: np.ndarray) -> np.ndarray:
    """``BANDS`` signed keys of a set, none of the empty one."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), CHUNK):
        least = np.minimum(least, (found[at:at + CHUNK, None] * FACTORS).min(0))
    return np.array([xxhash.xxh64_intdigest(least[ROWS * b:ROWS * (b + 1)].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def _sketched(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, counts, keys, prints = [], [], [], []
            for text in batch.column(1):  # one text's hashes at a time
                every = hashes(text.as_py(), size)
                found = np.unique(every)
                marks.append(mark(found)), counts.append(len(found)), keys.append(band_keys(found)), prints.append(simhash.majority(every))
            arrays = [batch.column(0), pa.array(marks, pa.int64()), pa.array(counts, pa.int64()),
                      pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(prints, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "fp", "n", "keys", "sim"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), size) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([mark(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["fp", "set"])

    return run


def forest(names: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that connect sets as all pairs of similarity ``least`` would, at most one less than there are sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    number = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(owner) else owner
    holders = owner[np.argsort(number, kind="stable")]  # by shingle, the sets that hold it
    starts = np.concatenate([[0], np.cumsum(np.bincount(number))]).astype(np.int64)
    ends = np.cumsum(sizes)
    group, links = np.arange(len(sets)), []
    for i in range(len(sets)):
        mine = number[ends[i] - sizes[i]:ends[i]]
        lengths = starts[mine + 1] - starts[mine]
        at = np.repeat(starts[mine] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        both = np.bincount(holders[at], minlength=len(sets))
        for j in np.flatnonzero((both + 1e-9 >= least * (sizes + sizes[i] - both)) & (group != group[i])).tolist():
            if group[j] != group[i]:
                links.append((int(names[i]), int(names[j])))
                group[group == group[j]] = group[i]
    return links


def _compared(least: float):
    def run(table: pa.Table) -> pa.Table:
        names = table.column("fp").to_numpy()
        sets = [np.asarray(s.values) for s in table.column("set").combine_chunks()]
        links = forest(names, sets, least)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def simhash_keys(rows: DataFrame, crowd: int = 64) -> DataFrame:
    """``(fp, n, key)`` of sets ``(fp, n, sim)``: one key for all whose fingerprints hang together by links of at most two bits."""
    marked = rows.where("n > 0").select("fp", "n", "sim").distinct()
    groups = simhash.components(simhash.linked(marked.select(F.col("sim").alias("fp")).distinct(), crowd))
    key = F.xxhash64(F.lit("simhash"), F.coalesce("label", "sim"))
    return marked.join(groups.withColumnRenamed("node", "sim"), "sim", "left").select("fp", "n", key.alias("key")).distinct()


def _crowd_links(crowded: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links inside the crowds of ``crowded (key, fp)``, enough to keep every pair of similarity ``least`` connected."""
    hubs = crowded.groupBy("key").agg(F.min("fp").alias("a"), F.count("*").alias("_held"))
    crowds = components(hot_key_join(crowded, hubs, ["key"], "_held").select("a", F.col("fp").alias("b"))).select(F.col("node").alias("fp"), F.col("label").alias("crowd"))
    members = crowds.join(sets, "fp").select("fp", "crowd", F.size("set").alias("n"))
    sizes = members.groupBy("crowd").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    dealt = cut(members.join(F.broadcast(sizes), "crowd").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks")).select("fp", "crowd", "blocks", "block"))

    def compared(tasks: DataFrame) -> DataFrame:
        return cut(tasks.distinct().join(sets, "fp").groupBy("crowd", "i", "j").applyInArrow(_compared(least), "a long, b long"))

    before = F.pmod(F.col("block") - 1, F.col("blocks"))
    near = compared(dealt.select("fp", "crowd", F.explode(F.array("block", before)).alias("i"), F.lit(0).cast("long").alias("j")))
    named = dealt.join(components(near).withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    largest = named.groupBy("crowd", "label").agg(F.count("*").alias("k")).groupBy("crowd").agg(F.max_by("label", F.struct("k", "label")).alias("top"))
    rest = cut(named.join(F.broadcast(largest), "crowd").where("label <> top").select("fp", "crowd", "blocks", "block"))
    parts = rest.groupBy("crowd").agg(F.ceil(F.count("*") / BLOCK_SETS).alias("a"), F.max("blocks").alias("blocks"))
    parts = parts.select("crowd", F.least("a", "blocks").cast("long").alias("parts"))
    strays = rest.join(F.broadcast(parts), "crowd").select("fp", "crowd", F.pmod("block", "parts").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"))
    all_of = dealt.join(F.broadcast(parts), "crowd").select("fp", "crowd", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i"), F.col("block").alias("j"))
    return near.union(compared(strays.union(all_of)))


def near_duplicates(docs: DataFrame, size: int = 5, least: float = 0.8, crowd: int = 64, broadcast_rows: int = 500_000) -> DataFrame:
    """``(doc_id, fp, component_id, group_fp)`` as ``simhash.near_duplicates`` gives them; ``fp`` names the shingle set.

    Texts without words have equal, empty sets and are linked. Nulls, repeated rows and empty tables are treated as
    there. The ids of candidates are broadcast while they number at most ``broadcast_rows``.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_of().alias("text"))
    rows = cut(mapped(texts, _sketched(size), f"doc_id {kind}, fp long, n long, keys array<long>, sim long"))
    marks = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    keyed = cut(simhash_keys(rows, crowd)).union(marks.select("fp", "n", F.explode("keys").alias("key")))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    shared = cut(hot_key_join(keyed, sizes, ["key"], "held"))
    few = shared.where(F.col("held") <= crowd).select("key", "fp", "n")
    crowded = shared.where(F.col("held") > crowd).select("key", "fp")
    wanted = cut(shared.select("fp").distinct())
    ids = marks.join(wanted, "fp").select(F.col("first").alias("id")).distinct()
    small = wanted.count() <= broadcast_rows
    near = texts.join(F.broadcast(ids) if small else ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
    sets = mapped(near, _sets(size), "fp long, set array<long>").join(F.broadcast(wanted) if small else wanted, "fp", "left_semi")
    sets = cut(sets.groupBy("fp").agg(F.first("set").alias("set")))

    def verified(pairs: DataFrame) -> DataFrame:
        met = pairs.join(sets.select(F.col("fp").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("set").alias("y")), "b")
        both = F.size(F.array_intersect("x", "y"))
        return met.where(both + 1e-9 >= (F.size("x") + F.size("y") - both) * least).select("la", "lb")

    def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
        """Groups ``(fp, label)`` after links between labels."""
        merged = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        return cut(groups.join(merged.withColumnRenamed("node", "l").withColumnRenamed("label", "to"), F.col("label") == F.col("l"), "left").select("fp", F.coalesce("to", "label").alias("label")))

    alike = (F.least("m", "n") + 1e-9 >= F.greatest("m", "n") * least) & (F.col("la") != F.col("lb"))
    group = wanted.select("fp", F.col("fp").alias("label"))
    if crowded.limit(1).count():
        group = joined(group, _crowd_links(crowded, sets, least).select(F.col("a").alias("la"), F.col("b").alias("lb")))
    now = cut(few.join(group, "fp"))
    hubs = now.groupBy("key").agg(F.min(F.struct("fp", "n", "label")).alias("h")).select("key", F.col("h.fp").alias("a"), F.col("h.n").alias("m"), F.col("h.label").alias("la"))
    spokes = now.select("key", F.col("fp").alias("b"), "n", F.col("label").alias("lb")).join(hubs, "key").where(alike)
    group = joined(group, verified(cut(spokes.select("a", "b", "la", "lb").distinct())))
    now = cut(few.join(group, "fp"))
    open_keys = now.groupBy("key").agg((F.min("label") < F.max("label")).alias("open")).where("open").select("key")
    rest = now.join(open_keys, "key")
    one = rest.select("key", F.col("fp").alias("a"), F.col("n").alias("m"), F.col("label").alias("la"))
    two = rest.select("key", F.col("fp").alias("b"), "n", F.col("label").alias("lb"))
    apart = one.join(two, (one["key"] == two["key"]) & (F.col("a") < F.col("b")) & alike)
    group = joined(group, verified(cut(apart.select("a", "b", "la", "lb").distinct()))).select(F.col("fp").alias("node"), "label")
    whole = marks.join(group.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("group_fp"))
    roots = whole.groupBy("group_fp").agg(F.min("first").alias("component_id"))
    return rows.join(whole.join(roots, "group_fp").select("fp", "component_id", "group_fp"), "fp").select("doc_id", "fp", "component_id", "group_fp")
