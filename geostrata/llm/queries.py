"""The operators of this subpackage as named queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm import chat, embedding_dedup, lexical_search, mixing, packing, quality, secret_scan, sharding, simhash, token_counts, token_files, topk, turn_repair
from geostrata.llm.common import table
from geostrata.llm.oracles import ORACLES
from geostrata.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), longest=1024, with_ids=False)


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = mixing.allocate(table(spark, sf_dir, "documents"))
    return share.select("doc_id", "source", "size", "source_size", "target", "taken", "shard_1", "shard_2")


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


@query
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


@query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=40, folder=scratch_path(spark, "slot-maps"), begun_with=32)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = token_counts.counted(table(spark, sf_dir, "documents"))
    after = token_counts.edited(state.withColumn("edits", token_counts.sample_edits(F.col("text"))))
    return after.select("doc_id", "tokens_before", "tokens_after", "encoded_chars", "leaves", F.length("text").cast("long").alias("chars"))


@query
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, end_id=2)
    return token_files.read(spark, folder)


@query
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turn_repair.audited(turn_repair.damaged(conversations), conversations.select("conv_id"))


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k=10)


__all__ = ["ORACLES", "QUERIES"]
