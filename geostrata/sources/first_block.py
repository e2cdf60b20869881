"""The beginning of many files, whatever their length: a data source that reads one block of each.

``spark.read.text`` has to pass over whole files to give their first lines. Here a partition holds some file names, opens
each where Python can reach the store, reads ``block`` bytes of it and closes it. Where the store is one that only
Spark reaches, the caller falls back to Spark's reader.
"""

from __future__ import annotations

import gzip
import hashlib
import sys
import zlib
from collections.abc import Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 1 << 16
FILES_A_TASK = 64
SCHEMA = "path string, size long, read long, whole boolean, head string"


class Names(InputPartition):
    def __init__(self, paths: Sequence[str]):
        self.paths = list(paths)


class FirstBlockReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["paths"].split("\n") if options["paths"] else []
        self.block, self.a_task = int(options.get("block", BLOCK)), int(options.get("files_a_task", FILES_A_TASK))

    def partitions(self) -> list[Names]:
        return [Names(self.paths[i:i + self.a_task]) for i in range(0, len(self.paths), self.a_task)] or [Names([])]

    def read(self, partition: Names) -> Iterator[tuple]:
        from pyarrow import fs

        for path in partition.paths:
            plain = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
            store, name = fs.FileSystem.from_uri(plain)
            size = store.get_file_info(name).size
            with store.open_input_file(name) as f:
                raw = f.read(self.block)
            whole = len(raw) >= size
            if path.lower().endswith(".gz"):
                unzip = zlib.decompressobj(wbits=31)
                text = unzip.decompress(raw, self.block) if not whole else gzip.decompress(raw)[:self.block]
                whole = whole and len(text) < self.block
            else:
                text = raw
            yield path, size, len(raw), whole, text.decode("utf-8", "replace")


class FirstBlock(DataSource):
    @classmethod
    def name(cls) -> str:
        return "first_block"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FirstBlockReader:
        return FirstBlockReader(self.options)


class Range(InputPartition):
    def __init__(self, path: str, number: int, start: int, length: int):
        self.path, self.number, self.start, self.length = path, number, start, length


class RangeDigestReader(DataSourceReader):
    def __init__(self, options):
        self.files = [line.split("\t") for line in options["files"].split("\n")] if options["files"] else []
        self.block = int(options["block"])

    def partitions(self) -> list[Range]:
        return [Range(p, i, at, min(self.block, int(size) - at)) for p, size in self.files for i, at in enumerate(range(0, max(int(size), 1), self.block))]

    def read(self, partition: Range) -> Iterator[tuple]:
        from pyarrow import fs

        path, digest, left = partition.path, hashlib.md5(), partition.length
        plain = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
        store, name = fs.FileSystem.from_uri(plain)
        with store.open_input_file(name) as f:
            f.seek(partition.start)
            while left > 0 and (part := f.read(min(left, 1 << 20))):
                digest.update(part)
                left -= len(part)
        yield path, partition.number, digest.hexdigest()


class RangeDigest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "range_digest"

    def schema(self) -> str:
        return "path string, number int, digest string"

    def reader(self, schema) -> RangeDigestReader:
        return RangeDigestReader(self.options)


def range_digests(spark: SparkSession, sizes: Sequence[tuple[str, int]], block: int) -> DataFrame:
    """``(path, number, digest)``: the MD5 of every ``block`` bytes of each file, a task per range, a megabyte in memory."""
    _by_value(spark, RangeDigest)
    return spark.read.format("range_digest").option("files", "\n".join(f"{p}\t{n}" for p, n in sizes)).option("block", block).load()


def reachable(paths: Sequence[str]) -> bool:
    """Does Python know how to open these paths' store?"""
    from pyarrow import fs

    schemes = {p.split(":", 1)[0] for p in paths if ":" in p.split("/", 1)[0]}
    if schemes <= {"file"}:
        return True
    try:
        for p in paths[:1]:
            fs.FileSystem.from_uri(p)
    except Exception:
        return False
    return True


def _by_value(spark: SparkSession, source: type[DataSource]) -> None:
    """Register a source so that workers need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(source)


def first_blocks(spark: SparkSession, paths: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``(path, size, read, whole, head)`` of each file; ``read`` bytes were read, ``whole`` tells whether that is all of it."""
    _by_value(spark, FirstBlock)
    return spark.read.format("first_block").option("paths", "\n".join(paths)).option("block", block).load()
