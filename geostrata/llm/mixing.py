"""Mixing sources to target weights with exact quotas.

Sources get shares of a budget of words by weight; a share stops at ``most`` times the source's size and the excess
is shared anew. Inside a source the documents stand in a fixed random order (a seeded hash), read once or twice
until the target is met: this stream is cut into blocks of ``block_words`` words, and the number of blocks is the
source's exact quota.

The quotas go to output shards down a binary tree. At every node the two halves get equal numbers of blocks, and
how many of each source go left is a multivariate hypergeometric draw, taken source by source from the exact
conditional distribution; so every shard is a draw without replacement from the whole mix, and the tree never sees
more than one count per source and node. A shard takes its next blocks of every source's order, so no block is used
twice, and shuffles them locally.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.llm.common import WORD, text_of
from geostrata.session import cut

WEIGHTS = (5, 2, 1)
FINE = 52  # the upper 12 bits of a mark: 4096 stretches of a source's order
SPREAD_LEVELS = 8
SALTS = 64


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """``(doc_id, src, size, mark)``: the source as a key that is never null, words, and the place in the order."""
    text = text_of()
    return docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("src"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", text).alias("mark"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(src, source_size, pos, target)`` of ``sizes (src, source_size)``; one row per source.

    Sources are weighed by code point, null last. With sources in order of the level at which they are full, the
    common level is the first at which the next source is not above its limit.
    """
    named = sizes.withColumn("pos", F.row_number().over(Window.orderBy(F.col("src") == "", "src")) - 1)
    cycle = F.array(*[F.lit(w) for w in weights])
    named = named.withColumn("w", F.element_at(cycle, (F.col("pos") % len(weights) + 1).cast("int")).cast("long"))
    full = (F.col("source_size") * F.lit(float(most))).alias("full")
    named = named.select("src", "source_size", "pos", "w", full).withColumn("at", F.col("full") / F.col("w"))
    order = Window.orderBy("at", "pos")
    before = F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    named = named.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(budget)) - before) / rest)
    level = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "pos", "level"))).over(every)["level"]
    return named.withColumn("common", level).select(
        "src", "source_size", "pos", F.least("full", F.col("w") * F.coalesce("common", F.col("at"))).alias("target"))


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """Good ones among ``drawn`` of ``total`` things, ``good`` of them good, by inversion at ``u`` in [0, 1).

    Probabilities follow from their ratios; beyond twelve standard deviations nothing is left in double precision.
    """
    lo = F.greatest(F.lit(0), drawn - (total - good))
    hi = F.least(good, drawn)
    mean = drawn * good / F.greatest(total, F.lit(1))
    reach = 12 * F.sqrt(mean * (1 - good / F.greatest(total, F.lit(1)))) + 2
    low = F.greatest(lo, F.floor(mean - reach)).cast("long")
    high = F.least(hi, F.ceil(mean + reach)).cast("long")
    ks = F.sequence(low, F.greatest(low, high))

    def ratio(k: Column) -> Column:  # of the probabilities of k + 1 and k
        return (good - k) * F.lit(1.0) * (drawn - k) / ((k + 1) * F.lit(1.0) * (total - good - drawn + k + 1))

    whole = F.aggregate(
        ks, F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum")),
        lambda s, k: F.struct((s["p"] * F.when(k < high, ratio(k)).otherwise(0.0)).alias("p"), (s["sum"] + s["p"]).alias("sum")),
    )["sum"]
    found = F.aggregate(
        ks, F.struct(F.lit(1.0).alias("p"), (u * whole).alias("left"), low.alias("k")),
        lambda s, k: F.struct(
            (s["p"] * F.when(k < high, ratio(k)).otherwise(0.0)).alias("p"), (s["left"] - s["p"]).alias("left"),
            F.when(s["left"] >= 0, k).otherwise(s["k"]).alias("k")),
    )
    return found["k"]


def split_tree(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """``(shard, pos, n)``: blocks of source ``pos`` in each of 2^depth shards, from ``quotas (pos, n)``.

    A node is one row with a count per source; levels need no shuffle but for spreading the nodes.
    """
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("blocks")).select(F.lit(1).cast("long").alias("node"), "blocks")

    def total(column: Column) -> Column:
        return F.aggregate(column, F.lit(0).cast("long"), lambda s, b: s + b["n"])

    def draw(state: Column, block: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("node"), block["pos"]), 11) / F.lit(float(1 << 53))
        left = hypergeometric(state["total"], block["n"], state["room"], u)
        return F.struct(
            (state["total"] - block["n"]).alias("total"), (state["room"] - left).alias("room"),
            F.concat(state["left"], F.array(F.struct(block["pos"].alias("pos"), left.alias("n")))).alias("left"))

    for level in range(depth):
        start = F.struct(
            total(F.col("blocks")).alias("total"), F.floor(total(F.col("blocks")) / 2).cast("long").alias("room"),
            F.array().cast("array<struct<pos:int,n:bigint>>").alias("left"))
        halves = nodes.select("node", "blocks", F.explode(F.array(F.aggregate("blocks", start, draw)["left"])).alias("left"))
        right = F.zip_with("blocks", "left", lambda b, x: F.struct(b["pos"].alias("pos"), (b["n"] - x["n"]).alias("n")))
        nodes = halves.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("blocks")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("blocks")))).alias("h")).select("h.*")
        if level % SPREAD_LEVELS == SPREAD_LEVELS - 1:
            nodes = nodes.repartition("node")
    return nodes.select((F.col("node") - (1 << depth)).alias("shard"), F.inline("blocks"))


def _filled(fits: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One reading of ``fits (src, size, mark, doc_id, at)``, none larger than its source's gap in ``gaps (src, gap)``.

    Taken are the documents before the first that does not fit, ``(src, mark, at, short)`` with the words still open
    at each; then the documents that fit what is left, and the gaps left. The first document is always taken.
    """
    rows = fits.withColumn("stretch", F.shiftrightunsigned("mark", FINE))
    upto = Window.partitionBy("src").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    begin = rows.groupBy("src", "stretch").agg(F.sum("size").alias("sum")).select("src", "stretch", F.coalesce(F.sum("sum").over(upto), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("src", "stretch").orderBy("mark", "at").rowsBetween(Window.unboundedPreceding, -1)
    # stretches that begin beyond the gap hold nothing to take: they need no order
    ahead = rows.join(begin.join(gaps, "src").where("begin < gap"), ["src", "stretch"])
    ahead = ahead.withColumn("short", F.col("gap") - F.col("begin") - F.coalesce(F.sum("size").over(inside), F.lit(0)))
    taken = cut(ahead.where("size <= short").select("src", "mark", "at", "size", "short"))
    sums = taken.groupBy("src").agg(F.sum("size").alias("sum"))
    gaps = cut(gaps.join(sums, "src", "left").select("src", (F.col("gap") - F.coalesce("sum", F.lit(0))).alias("gap")))
    rest = fits.join(gaps, "src").where("size <= gap").drop("gap").join(taken.select("src", "mark", "at"), ["src", "mark", "at"], "left_anti")
    return taken.select("src", "mark", "at", "short"), cut(rest.select("src", "size", "mark", "doc_id", "at")), gaps


def _read_on(fits: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All readings of ``_filled`` until no document fits: the documents taken, and the gaps left."""
    taken = []
    while fits.limit(1).count():
        some, fits, gaps = _filled(fits, gaps)
        taken.append(some)
    none = fits.select("src", "mark", "at", F.col("at").alias("short"))
    return reduce(DataFrame.union, taken, none), gaps


def allocate(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, most: float = 2.0,
    block_words: int = 4096, shard_blocks: int = 1024, seed: int = 42,
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken, shard_1, shard_2, mark``.

    ``taken`` counts words, a document taken twice counting twice; ``shard_1`` and ``shard_2`` hold its copies (null:
    not taken). Whole documents are taken in the source's order while they fit; documents larger than what is left
    are skipped and the order is read on until none fits. Then the smallest document not taken in this reading goes
    in, and for it documents from the end of the reading go out as long as they fit its excess, if that comes nearer
    to the target than the gap does.

    Null sources are one source, the last. A null or empty text has size 0 and is taken where it stands in the
    order. Null or repeated ids and repeated rows are rows like any other; other columns are not read; an empty
    table gives no rows. Reruns agree: the order hangs on id, text and ``seed`` only.
    """
    if most > 2 or budget > most:
        raise ValueError("a document is taken at most twice, and the budget must fit below the limit")
    rows = cut(measured(docs, seed))
    goal = cut(targets(rows.groupBy("src").agg(F.sum("size").alias("source_size")), weights, budget, most)
               .withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
               .withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("quota") / block_words)).cast("long")))
    # running totals: of stretches of the order first, then inside each stretch
    rows = rows.withColumn("stretch", F.shiftrightunsigned("mark", FINE))
    upto = Window.partitionBy("src").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    begin = rows.groupBy("src", "stretch").agg(F.sum("size").alias("sum")).select("src", "stretch", F.coalesce(F.sum("sum").over(upto), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("src", "stretch").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(begin, ["src", "stretch"])
    at = F.col("begin") + F.col("inside")
    first = at + F.col("size") <= F.col("quota")
    second = at + F.col("size") + F.col("source_size") <= F.col("quota")
    placed = cut(placed.join(goal, "src").select(
        "doc_id", "src", "size", "mark", "source_size", "target", "quota", "pos", "n", at.alias("at"), first.alias("one"), second.alias("two")))
    # what the last reading leaves open: documents that still fit, on in the order, until none does
    again = F.col("quota") >= F.col("source_size")
    last = F.when(again, F.col("two")).otherwise(F.col("one"))
    held = placed.groupBy("src").agg(F.sum(F.when(last, F.col("size")).otherwise(0)).alias("held"))
    gaps = cut(goal.join(held, "src").select("src", (F.col("quota") - F.when(again, F.col("source_size")).otherwise(F.lit(0)) - F.col("held")).alias("gap")))
    fits = cut(placed.where(~last & (F.col("size") > 0)).join(gaps, "src").where("size <= gap").select("src", "size", "mark", "doc_id", "at"))
    late, gaps = _read_on(fits, gaps)
    # texts without words share their place with a neighbour's and are never late
    key = ["src", "mark", "at"]
    late = late.select(*key, "short", F.lit(True).alias("late"))
    placed = cut(placed.join(late, key, "left").withColumn("late", F.coalesce("late", F.lit(False)) & ~last & (F.col("size") > 0)))
    # the smallest of the others is larger than the rest: it is taken if that, less what can be left out for it, is nearer
    out = ~last & ~F.col("late") & (F.col("size") > 0)
    # a large source is spread over salts: first the best of each salt, then of the source
    salted = gaps.where("gap > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    best = F.min(F.struct("size", "mark", "doc_id", "at")).alias("f")
    fillers = placed.where(out).withColumn("salt", F.pmod("mark", F.lit(SALTS)).cast("int")).join(salted, ["src", "salt"])
    fillers = fillers.groupBy("src", "salt").agg(best).groupBy("src").agg(F.min("f").alias("f"))
    fillers = cut(gaps.join(fillers, "src", "left").select("src", "gap", F.col("f.at").alias("f_at"), F.col("f.mark").alias("f_mark"), F.col("f.size").alias("f_size")))
    over = cut(fillers.where("f_size > gap").select("src", (F.col("f_size") - F.col("gap")).alias("gap")))
    held = placed.where((last | F.col("late")) & (F.col("size") > 0)).join(over, "src").where("size <= gap")
    # from the end of the order, so that no hole is left in it
    less, over = _read_on(cut(held.select("src", "size", F.bitwise_not("mark").alias("mark"), "doc_id", "at")), over)
    fillers = fillers.join(over.withColumnRenamed("gap", "over"), "src", "left")
    fillers = cut(fillers.withColumn("use", F.coalesce(F.col("over") < F.col("gap"), F.lit(False))))
    less = less.join(fillers.where("use"), "src", "left_semi").select("src", F.bitwise_not("mark").alias("mark"), "at", F.lit(True).alias("less"))
    placed = placed.join(less, key, "left").withColumn("less", F.coalesce("less", F.lit(False)) & (F.col("size") > 0))
    chosen = F.col("use") & (F.col("mark") == F.col("f_mark")) & (F.col("at") == F.col("f_at")) & (F.col("size") == F.col("f_size"))
    extra = (F.coalesce(chosen, F.lit(False)) & out) | (F.col("late") & ~F.col("less"))
    block = lambda words: F.least(F.floor(words / block_words), F.col("n") - 1).cast("long")
    filled = block(F.col("quota") - F.when(F.col("late"), F.col("short")).otherwise(F.col("gap")))
    copies = placed.join(fillers, "src").select(
        "doc_id", "src", "size", "source_size", "target", "pos", "mark",
        F.when(F.col("one") & (again | ~F.col("less")), block(F.col("at"))).when(extra & ~again, filled).alias("block_1"),
        F.when(F.col("two") & ~F.col("less"), block(F.col("at") + F.col("source_size"))).when(extra & again, filled).alias("block_2"))
    # the tree deals the blocks to shards
    blocks = goal.agg(F.sum("n")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1, blocks) / shard_blocks)))
    tree = split_tree(goal.select("pos", "n"), depth, seed)
    ranges = tree.withColumn("from", F.coalesce(F.sum("n").over(Window.partitionBy("pos").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    dealt = cut(ranges.where("n > 0").select("shard", "pos", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)).alias("block")))
    for i in (1, 2):
        side = dealt.select("pos", F.col("block").alias(f"block_{i}"), F.col("shard").alias(f"shard_{i}"))
        copies = copies.join(side, ["pos", f"block_{i}"], "left")
    taken = F.col("size") * (F.col("block_1").isNotNull().cast("long") + F.col("block_2").isNotNull().cast("long"))
    source = F.when(F.col("src") != "", F.expr("substring(src, 2)"))
    return copies.select("doc_id", source.alias("source"), "size", "source_size", "target", taken.alias("taken"), "shard_1", "shard_2", "mark")


def mixed(docs: DataFrame, seed: int = 42, **how) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, none, one or two of each, with ``shard`` and ``place`` in it.

    The result is ``(row, shard, place)``; ``row`` is the input row. Rows equal in id, source and text are told
    apart by number, so each is taken as often as its share says.
    """
    text = text_of()
    src = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.lit(seed), "doc_id", text).alias("mark"), src.alias("src"))
    share = allocate(docs, seed=seed, **how).select(
        "mark", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("src"), F.array_compact(F.array("shard_1", "shard_2")).alias("shards")).where(F.size("shards") > 0)
    # equal rows share a mark: the k-th of them takes the k-th share
    share = share.groupBy("src", "mark").agg(F.sort_array(F.collect_list("shards")).alias("shares"))
    kth = F.row_number().over(Window.partitionBy("src", "mark").orderBy("mark"))
    copies = rows.join(share, ["src", "mark"]).withColumn("k", F.when(F.size("shares") > 1, kth).otherwise(kth))
    copies = copies.select("row", "mark", F.posexplode(F.get("shares", F.col("k") - 1)).alias("copy", "shard"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "mark", "copy"), "mark", "copy")) - 1
    return copies.select("row", "shard", place.alias("place"))
