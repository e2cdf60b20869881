"""Catalogue of files: listing, grouping, header peeks, line counts, fingerprints and drift."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions.columns import ratio
from geostrata.session import cut
from geostrata.sources.first_block import first_blocks, range_digests, reachable
from geostrata.sources.formats import EXTENSIONS

TEXT_FORMATS = ("csv", "tsv", "txt", "json", "jsonl", "nt")


def file_name(path: str | Column = "path") -> Column:
    return F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)


def _format(name: Column) -> Column:
    inner = F.regexp_replace(F.lower(name), r"\.gz$", "")
    ext = F.regexp_extract(inner, r"(\.[^.]+)$", 1)
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(table, ext)


def group_name(name: Column) -> Column:
    """Name without its extension (and ``.gz``), with every run of digits as ``#``."""
    bare = F.regexp_replace(name, r"(?i)\.gz$", "")
    known = "|".join(sorted((e[1:] for e in EXTENSIONS), key=len, reverse=True))
    return F.regexp_replace(F.regexp_replace(bare, rf"(?i)\.({known})$", ""), r"\d+", "#")


def scan(spark: SparkSession, root: str | Sequence[str], formats: Iterable[str] | None = None, recursive: bool = True,
         exclude: str | None = None) -> DataFrame:
    """One row per data file below ``root``; names starting with ``_`` or ``.`` are skipped.

    Listing only: file contents are pruned from the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(
        [root] if isinstance(root, str) else list(root)
    ).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    name = file_name("path")
    parts = F.split("path", "/")
    out = files.withColumns({"name": name, "format": _format(name), "parent": F.element_at(parts, -2), "group": group_name(name)})
    out = out.filter(F.col("format").isNotNull() & ~F.col("name").rlike(r"^[_.]"))
    if formats:
        out = out.filter(F.col("format").isin(list(formats)))
    if exclude:
        out = out.filter(~F.col("path").rlike(exclude))
    return out.orderBy(F.lower("path"))


def expand(spark: SparkSession, paths: Sequence[str], limit: int | None = None) -> tuple[list[str], list[str]]:
    """Files behind paths, folders and globs: unique, sorted, optionally capped, with notes."""
    found, notes = set(), []
    for raw in paths:
        p = str(raw).strip().strip("\"'")
        try:
            hits = [r["path"] for r in scan(spark, p).select("path").collect()]  # a listing, not data
        except Exception:
            notes.append(f"path not found: {raw}")
            continue
        if not hits:
            notes.append(f"no data files: {raw}")
        found.update(hits)
    files = sorted(found)
    if limit is not None and len(files) > limit:
        notes.append(f"{len(files)} files found, limited to the first {limit}")
        files = files[:limit]
    return files, notes


def text_facts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """First line and number of lines of every text file, in one pass (gzip is transparent)."""
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), "value",
        F.monotonically_increasing_id().alias("_id"),
    )
    return lines.groupBy("path").agg(
        F.min_by("value", F.struct("_at", "_id")).alias("first_line"), F.count("*").alias("lines"))


def first_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(path, first_line, sep)`` of every text file, from its first block; the separator is the most frequent one there.

    Files in a store that only Spark reaches, and first lines longer than a block, are read by Spark.
    """
    paths = list(paths)
    if not (paths and reachable(paths)):
        return text_facts(spark, paths).select("path", "first_line", separator_of("first_line").alias("sep"))
    head = F.regexp_replace("head", "^\ufeff", "")
    line = F.regexp_extract(head, r"^([^\r\n]*)", 1)
    ended = F.col("whole") | head.rlike(r"[\r\n]")
    sample = F.when(F.col("whole"), head).otherwise(F.regexp_extract(head, r"(?s)^(.*)[\r\n]", 1))
    blocks = cut(first_blocks(spark, paths).filter("size > 0").select("path", ended.alias("ended"), line.alias("first_line"), separator_of(sample).alias("sep")))
    long = [r[0] for r in blocks.filter("NOT ended").select("path").collect()]
    known = blocks.filter("ended").drop("ended")
    if not long:
        return known
    rest = text_facts(spark, long)
    return known.union(rest.select("path", "first_line", separator_of("first_line")))


def separator_of(line: Column | str) -> Column:
    """Most frequent of comma, tab, semicolon and bar; comma when none occurs."""
    c = F.col(line) if isinstance(line, str) else line
    count = lambda s: F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))
    order = [",", "\t", ";", "|"]
    best = F.greatest(*[count(s) for s in order])
    out = F.lit(",")
    for s in reversed(order):
        out = F.when((best > 0) & (count(s) == best), F.lit(s)).otherwise(out)
    return out


def peek_columns(facts: DataFrame, separator: str | None = None) -> DataFrame:
    """Header names per file from its first line (a byte-order mark is removed)."""
    line = F.regexp_replace("first_line", "^﻿", "")
    sep = F.lit(separator) if separator else F.col("sep") if "sep" in facts.columns else separator_of(line)
    pattern = F.concat(F.lit("\\Q"), sep, F.lit("\\E"))
    names = F.transform(F.split(line, pattern), lambda n: F.trim(F.regexp_replace(n, '^"|"$', "")))
    return facts.withColumn("columns", names)


def fingerprints(spark: SparkSession, paths: Sequence[str], max_bytes: int | None = None, truncate_sha: int | None = None,
                 block_bytes: int | None = None) -> DataFrame:
    """MD5 (or a shortened SHA-256) of each file with its size and time; null above ``max_bytes``.

    A whole file is one cell, so this form ends at 2 GB. With ``block_bytes`` the digest is the MD5 of the MD5s of the
    file's successive ranges of that size, read by as many tasks: for files of any size, in stores that Python reaches.
    """
    files = spark.read.format("binaryFile").load(list(paths))
    if block_bytes:
        facts = cut(files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")))
        sizes = [(r["path"], r["size"]) for r in facts.collect() if max_bytes is None or r["size"] <= max_bytes]  # a listing
        parts = range_digests(spark, sizes, block_bytes).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("number", "digest"))).alias("d"))
        return facts.join(parts.select("path", F.md5(F.array_join("d.digest", "").cast("binary")).alias("digest")), "path", "left")
    small = files if max_bytes is None else files.filter(F.col("length") <= max_bytes)
    digest = F.md5("content") if truncate_sha is None else F.substring(F.sha2("content", 256), 1, truncate_sha)
    hashed = small.select("path", digest.alias("digest"))
    facts = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return facts.join(hashed, "path", "left")


def distribution(files: DataFrame, by: str) -> DataFrame:
    """Files, bytes and share of bytes per format or per folder."""
    total = files.agg(F.sum("size")).first()[0] or 0
    return files.groupBy(by).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), ratio(F.sum("size"), F.lit(total)).alias("share"),
        F.array_join(F.array_sort(F.collect_set("format")), ",").alias("formats"))


def group_summary(files: DataFrame) -> DataFrame:
    """Per group: files, formats, bytes, lines and the union of columns."""
    columns = files.select("group", F.explode("columns").alias("c")).groupBy("group").agg(
        F.array_sort(F.collect_set("c")).alias("columns"))
    sums = files.groupBy("group").agg(
        F.count("*").alias("files"), F.array_sort(F.collect_set("format")).alias("formats"), F.sum("size").alias("bytes"), F.sum("lines").alias("lines"))
    return sums.join(columns, "group", "left")


def drift(files: DataFrame) -> DataFrame:
    """Columns added to or missing from each file against the first file of its group."""
    first = files.groupBy("group").agg(F.min_by("columns", "path").alias("_base"))
    out = files.join(first, "group").select(
        "group", "path", F.array_except("columns", "_base").alias("added"), F.array_except("_base", "columns").alias("missing"))
    return out.withColumn("consistent", (F.size("added") == 0) & (F.size("missing") == 0))


def schema_coverage(files: DataFrame) -> DataFrame:
    """Columns that only some files have."""
    n = files.select("path").distinct().count()
    per = files.select("path", F.explode("columns").alias("column")).groupBy("column").agg(F.countDistinct("path").alias("in_files"))
    return per.filter(F.col("in_files") < n).withColumn("of_files", F.lit(n))


def with_day(paths: Sequence[str], day: str, pattern: str = r"\d{4}\d{2}(\d{2})") -> list[str]:
    """Files whose name carries the given day of month."""
    out = []
    for p in paths:
        hit = re.search(pattern, p.rsplit("/", 1)[-1])
        if hit and hit.group(1) == day.zfill(2):
            out.append(p)
    return out


