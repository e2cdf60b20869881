"""Sharding over fixed virtual slots.

A record's hash puts it into one of a few thousand virtual slots, for good. Equal records have one hash; where very many
of them overload a virtual slot they are dealt over all of them. Bytes are summed per virtual slot, and
a versioned map gives every virtual slot a shard. Growing, shrinking or evening out means editing the map: a
record moves only when its virtual slot does. The map has one row per virtual slot, whatever the data's size.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.llm.common import text_of
from geostrata.session import cut

SLOTS = 4096
OVERHEAD = 16
MANY = 64
MAP = "version int, vslot int, shard int, bytes long, records long"


def measured(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``(doc_id, size, text_crc32, mark, vslot)`` of every row; a null text has no bytes and the checksum of none.

    ``mark`` is the record's hash by id and text, so repeated or null ids spread; it gives the virtual slot.
    """
    text = text_of()
    rows = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("doc_id", text).alias("mark"),
    )
    return rows.withColumn("vslot", F.pmod("mark", F.lit(slots)).cast("int"))


def spread_copies(rows: DataFrame, slots: int = SLOTS, many: int = MANY) -> DataFrame:
    """Measured rows with equal records of overloaded virtual slots dealt over all virtual slots by their place in the table.

    A virtual slot is overloaded above twice the mean; there, records that occur more than ``many`` times are dealt.
    Only rows of such slots are counted by record, and their names are bounded: no more than ``slots`` records can each
    stand for a slot's mean, so the broadcast is of at most that many rows.
    """
    load = cut(rows.groupBy("vslot").agg(F.count("*").alias("n")))
    mean = (load.agg(F.sum("n")).first()[0] or 0) / slots
    heavy = load.where(F.col("n") > 2 * mean + many).select("vslot")  # at most half of all virtual slots
    least = max(many, mean / 2)
    inside = rows.join(F.broadcast(heavy), "vslot", "left_semi").groupBy("mark").count()
    crowds = cut(inside.where(F.col("count") > least).select("mark", F.lit(True).alias("crowd")))  # at most 2 * slots rows
    if crowds.isEmpty():
        return rows
    dealt = F.pmod(F.xxhash64("mark", F.monotonically_increasing_id()), F.lit(slots)).cast("int")
    told = rows.withColumn("deal", dealt).join(F.broadcast(crowds), "mark", "left")
    return cut(told.withColumn("vslot", F.when(F.col("crowd"), F.col("deal")).otherwise(F.col("vslot"))).drop("deal", "crowd"))


def loads(rows: DataFrame) -> DataFrame:
    """Bytes and records per virtual slot; partial sums before the shuffle."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))


def _deal(one: DataFrame) -> DataFrame:
    """One row ``(slots, shards)``: virtual slots in falling bytes, each to the shard with the fewest bytes so far.

    The row's size is fixed by the number of virtual slots and shards, not by the data.
    """
    start = F.struct(F.col("shards"), F.array().cast("array<int>").alias("dealt"))

    def give(state: Column, slot: Column) -> Column:
        least = F.array_min(state["shards"])
        more = F.struct((least["held"] + slot["bytes"]).alias("held"), least["shard"].alias("shard"))
        grown = F.transform(state["shards"], lambda s: F.when(s["shard"] == least["shard"], more).otherwise(s))
        return F.struct(grown.alias("shards"), F.concat(state["dealt"], F.array(least["shard"])).alias("dealt"))

    dealt = one.select("slots", F.aggregate("slots", start, give)["dealt"].alias("dealt"))
    return dealt.select(F.inline(F.arrays_zip("slots", "dealt"))).select(
        "slots.vslot", F.col("dealt").alias("shard"), "slots.bytes", "slots.records")


def _in_falling_bytes() -> Column:
    slot = F.struct((-F.col("bytes")).alias("less"), "vslot", "bytes", "records")
    return F.sort_array(F.collect_list(slot)).alias("slots")


def new_map(load: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """First map of virtual slots with ``load (vslot, bytes, records)`` to ``shards`` shards of near equal bytes."""
    nobody = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(F.lit(0).cast("long").alias("held"), i.alias("shard")))
    return _deal(load.agg(_in_falling_bytes()).withColumn("shards", nobody)).select(F.lit(version).alias("version"), "*")


def rebalanced(old: DataFrame, load: DataFrame, shards: int, version: int) -> DataFrame:
    """The next version for ``shards`` shards and new loads, moving few virtual slots.

    Every shard keeps its virtual slots, in order of their hash, up to an equal share of all bytes; what stands
    beyond, and what lay on shards that no longer exist, goes to the shards with room.
    """
    share = load.agg(F.sum("bytes")).first()[0] or 0
    now = old.select("vslot", "shard").join(load, "vslot", "full").select(
        "vslot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("records", F.lit(0)).alias("records"))
    upto = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.xxhash64("vslot"), "vslot"))
    stays = (F.col("shard") < shards) & (upto <= F.greatest(F.lit(share / shards), F.col("bytes")))
    held = cut(now.withColumn("stays", F.coalesce(stays, F.lit(False))))
    kept = held.where("stays").groupBy("shard").agg(F.sum("bytes").alias("held"))
    every = held.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(kept, "shard", "left")
    room = every.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).cast("long").alias("held"), "shard"))).alias("shards"))
    loose = held.where("NOT stays").agg(_in_falling_bytes())
    one = loose.withColumn("one", F.lit(1)).join(room.withColumn("one", F.lit(1)), "one")  # a row each
    whole = held.where("stays").select("vslot", "shard", "bytes", "records").union(_deal(one))
    return whole.select(F.lit(version).alias("version"), "*")


def store_map(slot_map: DataFrame, folder: str) -> None:
    """Add a version to the stored map: one folder per version, older ones stay readable."""
    version = slot_map.select("version").first()
    if version is not None:
        slot_map.write.mode("errorifexists").parquet(os.path.join(folder, f"v{version[0]:06d}"))


def load_map(spark, folder: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(os.path.join(folder, f"v{version:06d}"))


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and place in the shard, gapless from 0, of measured rows.

    Places are counted inside the virtual slot and moved on by what the shard's earlier virtual slots hold, so no
    task sorts a whole shard.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    begin = slot_map.select("vslot", "shard", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    # one row per virtual slot: bounded whatever the data's size
    return rows.withColumn("place", F.row_number().over(inside).cast("long") - 1).join(F.broadcast(begin), "vslot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("place")).alias("slot"), "vslot")


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, folder: str | None = None, begun_with: int | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot, vslot, map_version)`` of every row, shards near equal in bytes.

    The law that holds is ``bytes``: as equal as whole virtual slots allow, a virtual slot being a few documents
    or a 4096th of the corpus. With ``folder`` the map is stored there as version 1. With ``begun_with``, version 1 is
    for that many shards and is then rebalanced into version 2 for ``shards``; rows are placed from what was read
    back. A null text counts as empty, null and repeated ids are placed like any other, and so are repeated rows, which
    are dealt over all shards where they are many. Columns beside id and text are not read, and an empty table
    gives no rows.
    """
    rows = spread_copies(cut(measured(docs, slots)), slots)
    load = cut(loads(rows))
    slot_map, version = cut(new_map(load, begun_with or shards)), 1
    if folder:
        store_map(slot_map, folder)
    if begun_with:
        slot_map = load_map(docs.sparkSession, folder, 1) if folder and not load.isEmpty() else slot_map
        slot_map, version = cut(rebalanced(slot_map, load, shards, 2)), 2
        if folder:
            store_map(slot_map, folder)
            slot_map = load_map(docs.sparkSession, folder, 2) if not load.isEmpty() else slot_map
    return placed(rows, slot_map).withColumn("map_version", F.lit(version))
