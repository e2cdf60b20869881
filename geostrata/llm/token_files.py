"""Token ids of a corpus in wavelet files, one file per shard of successive documents.

Documents are dealt by ranges of their id, so files and the documents in them follow each other in ascending order and
no task needs more than its own range. A task closes a file at ``SHARD_TOKENS`` ids. A file's name ends in a token of its
own, and only files that the manifest names count: a task that is run twice leaves a file that nobody reads.

The place of a document in the whole corpus is the sum of three parts: the ids of earlier ranges, of earlier files of the
range and of earlier documents of the file.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostrata.llm.common import ship, text_of
from geostrata.llm.tokens import NOT_LATIN
from geostrata.llm.wavelet import WaveletFile, encode

SHARD_TOKENS = 1 << 22
MANIFEST = "part int, file_no int, file string, docs long, tokens long, bytes long"
HELD_WORDS, LONGEST_WORD = 400_000, 64
_OWN = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that stand for themselves in a byte-level vocabulary
SHOWN = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - _OWN))}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder(dict):
    """Ids of texts by a tokenizer that drops white space, as little-endian unsigned 32-bit bytes.

    Such a tokenizer's tokens never cross white space, so a text's ids are those of its words, each asked for once and
    then held. Words are parted at the six ASCII spaces only; the library sees to all others.

    Where the file's normalizer only composes, folds white space and lower-cases, and its pattern takes letters together
    and other signs apart, the library's model is asked for a Latin word's letters and the signs behind them directly.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.parts = Tokenizer.from_file(path), {}
        self.model = self.tokenizer.model if self._plain(path) else None
        probe = self.ids("so it's a b\tc\nd")
        if probe != b"".join(self.ids(w) for w in "so it's a b c d".split()):
            raise ValueError("the tokenizer does not drop white space")

    @staticmethod
    def _plain(path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        norm, pre, special = file.get("normalizer") or {}, file.get("pre_tokenizer") or {}, file.get("added_tokens", [])
        return (
            [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [n["type"] for n in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and pre["pretokenizers"][0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            and not any(t["content"].isalnum() or t["content"][:-1].isalnum() for t in special)
        )

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(SHOWN)
            found = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(self.parts) >= HELD_WORDS:
                self.parts.clear()
            self.parts[part] = found
        return found

    def _new(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.model is not None and len(word) <= LONGEST_WORD and (text.isascii() or NOT_LATIN.search(text) is None):
            low = text.lower()
            letters = low.rstrip(punctuation)
            if letters.isalpha():
                return self._part(letters) + self._part(low[len(letters):]) if len(letters) < len(low) else self._part(low)
        return self.ids(text)

    def __missing__(self, word: bytes) -> bytes:
        found = self._new(word)
        if len(word) <= LONGEST_WORD:
            if len(self) >= HELD_WORDS:
                self.clear()
            self[word] = found
        return found

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _store(folder: str):
    """The file system and path of a folder named by a full URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark itself would use, so that Python tasks mean the same place."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _writer(folder: str, path: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        store, base = _store(folder)
        part, number, owners, lengths, ids, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def closed() -> pa.RecordBatch:
            docs = pa.table({"doc_id": pa.concat_arrays(owners), "n_tokens": pa.array(lengths, pa.int64())})
            data = encode(np.frombuffer(b"".join(ids), "<u4"), docs)
            name = f"{part:08d}-{number:06d}-{uuid.uuid4().hex}.wm"
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(data)
            row = [[part], [number], [name], [len(lengths)], [held], [len(data)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 3))], ["part", "file_no", "file", "docs", "tokens", "bytes"])

        for batch in batches:
            names, texts, first = batch.column(0), batch.column(1), 0
            for i in range(len(texts)):
                data = enc.encode(texts[i].as_py()) + end
                ids.append(data), lengths.append(len(data) // 4)
                held += len(data) // 4
                if held >= most:
                    owners.append(names.slice(first, i + 1 - first))
                    yield closed()
                    number, owners, lengths, ids, held, first = number + 1, [], [], [], 0, i + 1
            owners.append(names.slice(first))
        if lengths:
            yield closed()

    return run


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the ids of every document and its end id to wavelet files below ``folder``; returns the manifest.

    Ascending ``doc_id``, null ids first; rows of one id follow each other by a hash of their text, and equal rows are
    dealt like others. A null or empty text is the end id alone. Other columns are not read. A text is never cut, so a
    task holds ``shard_tokens`` ids and one document. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    ship(spark)
    home = qualified(spark, folder)
    store, base = _store(home)
    store.create_dir(f"{base}/shards", recursive=True)
    order = ["doc_id", "h", "again"]
    rows = docs.select("doc_id", text_of().alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("again"), F.col("text").cast("binary"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(_writer(f"{home}/shards", tokenizer or default_tokenizer(), end_id, shard_tokens), MANIFEST).write.parquet(f"{home}/manifest")
    return manifest(spark, home)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``MANIFEST`` and ``begin``, the number of ids in all files before; one row per file."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    ranges = files.groupBy("part").agg(F.sum("tokens").alias("n"))  # a row per range, as many as the session's shuffle partitions
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return files.join(ranges, "part").select(
        *files.columns, (F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("begin"))


def _each_file(spark: SparkSession, folder: str, answer, schema: str) -> DataFrame:
    """``answer(WaveletFile, begin)`` of every file, one file in a task's memory at a time."""
    home = qualified(spark, folder)
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(f"{home}/shards")
        for batch in batches:
            for name, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{base}/{name}") as f:
                    yield answer(WaveletFile(f), begin)

    named = manifest(spark, home).select("file", "begin")
    return named.repartition(max(1, named.count())).mapInArrow(run, schema)


def _kind(spark: SparkSession, folder: str) -> str:
    """Spark's name of the stored ids' type, from the first file."""
    home = qualified(spark, folder)
    first = manifest(spark, home).select("file").first()
    if first is None:
        return "bigint"
    from pyspark.sql.pandas.types import from_arrow_type

    store, base = _store(f"{home}/shards")
    with store.open_input_file(f"{base}/{first[0]}") as f:
        return from_arrow_type(WaveletFile(f).docs().schema.field("doc_id").type).simpleString()


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of every stored document, decoded from the files.

    ``start`` counts the ids of all documents before; the checksum is over the ids as little-endian unsigned 32-bit
    integers. A batch holds the documents of one file.
    """

    def answer(file: WaveletFile, begin: int) -> pa.RecordBatch:
        docs, ids = file.docs(), file.all()
        n = docs.column("n_tokens").to_numpy()
        ends = np.cumsum(n)
        data = memoryview(ids.tobytes())
        sums = [zlib.crc32(data[4 * (e - k):4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
        arrays = [docs.column("doc_id").combine_chunks(), pa.array(begin + ends - n), pa.array(n), pa.array(sums, pa.int64())]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        if with_ids:
            edges = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            arrays, names = [*arrays, pa.ListArray.from_arrays(edges, pa.array(ids.astype(np.int32)))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(arrays, names)

    more = ", ids array<int>" if with_ids else ""
    return _each_file(spark, folder, answer, f"doc_id {_kind(spark, folder)}, start long, n_tokens long, ids_crc32 long{more}")


def count(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """``(token, n)``: occurrences of each of ``tokens`` in the corpus; reads the blocks that rank meets."""

    def answer(file: WaveletFile, begin: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.int64()), "n": pa.array([file.count(t) for t in tokens], pa.int64())})

    found = _each_file(spark, folder, answer, "token long, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """``(doc_id, place, position)`` of every occurrence: its place in the document and in the corpus."""

    def answer(file: WaveletFile, begin: int) -> pa.RecordBatch:
        docs, at = file.docs(), file.locate(token)
        n = docs.column("n_tokens").to_numpy()
        starts = np.cumsum(n) - n
        owner = np.searchsorted(starts, at, side="right") - 1
        names = docs.column("doc_id").combine_chunks().take(pa.array(owner))
        return pa.RecordBatch.from_arrays([names, pa.array(at - starts[owner]), pa.array(begin + at)], ["doc_id", "place", "position"])

    return _each_file(spark, folder, answer, f"doc_id {_kind(spark, folder)}, place long, position long")


def access(spark: SparkSession, folder: str, start: int, length: int) -> DataFrame:
    """``(position, token)`` for the corpus places ``start`` to ``start + length``, reading only the blocks they meet."""

    def answer(file: WaveletFile, begin: int) -> pa.RecordBatch:
        at = np.arange(max(start, begin), max(start, begin, min(start + length, begin + file.tokens)), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(file.access(at - begin))], ["position", "token"])

    return _each_file(spark, folder, answer, "position long, token long")
