"""Packing by power-of-two decomposition.

A document of L ids (its text's ids and the end id) is cut into pieces whose lengths are powers of two: as many
of the longest length as fit, then the binary digits of the rest. Every piece is a whole sequence of its own, so
no sequence crosses documents and nothing is padded; equal lengths form one bucket, from which batches of equal
shape are drawn.

Inside a bucket the sequences lie in ``SLOTS`` slots by a hash, and a sequence's number names bucket, slot and
place in the slot. No global count is needed: one pass over the texts, one shuffle of the pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geostrata.llm.common import mapped, ship, text_of
from geostrata.llm.tokens import default_tokenizer, encoder

SLOTS = 1024


def piece_lengths(total: int, longest: int) -> list[int]:
    """``total`` as powers of two up to ``longest``, long ones first."""
    rest = total % longest
    return [longest] * (total // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def _cutter(path: str, longest: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            owner, start, length, crc, total, ids = [], [], [], [], [], []
            held = 0

            def flush():
                arrays = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    arrays, names = [*arrays, pa.ListArray.from_arrays(pa.array(ends), flat)], [*names, "ids"]
                return pa.RecordBatch.from_arrays(arrays, names)

            for i, text in enumerate(batch.column(1)):
                data = enc.encode(text.as_py()) + end
                n, at = len(data) // 4, 0
                for size in piece_lengths(n, longest):
                    part = data[4 * at:4 * (at + size)]
                    owner.append(i), start.append(at), length.append(size), crc.append(zlib.crc32(part)), total.append(n)
                    if with_ids:
                        ids.append(part)
                        held += size
                    at += size
                    if held > 1_000_000:
                        yield flush()
                        for x in (owner, start, length, crc, total, ids):
                            x.clear()
                        held = 0
            if owner:
                yield flush()

    return run


def pack(docs: DataFrame, longest: int = 1024, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens[, ids], bucket, sequence_id, offset``.

    ``longest`` is a power of two. ``bucket`` is log2 of the length; batches of a bucket have equal shape. A null
    or empty text is a document of the end id alone. Repeated rows and repeated or null ids are packed once per
    row. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    ship(docs.sparkSession)
    ids = ", ids array<int>" if with_ids else ""
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = mapped(
        docs.select("doc_id", text_of().alias("text")), _cutter(tokenizer or default_tokenizer(), longest, end_id, with_ids),
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long{ids}",
    )
    pieces = pieces.withColumn("bucket", F.log2("length").cast("int")).withColumn(
        "slot", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SLOTS)).cast("int"))
    order = Window.partitionBy("bucket", "slot").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    place = F.row_number().over(order).cast("long") - 1
    number = F.shiftleft(F.col("bucket").cast("long"), 55) + F.shiftleft(F.col("slot").cast("long"), 44) + place
    return pieces.withColumn("sequence_id", number).withColumn("offset", F.lit(0).cast(T.LongType())).drop("slot")
