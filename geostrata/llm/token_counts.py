"""Edit-aware token counts.

A document's text is cut into leaves at places where a token can never run across: before a space that a non-space
follows. A leaf keeps its characters and its tokens, a segment tree over the leaves keeps their sums. An edit finds
the leaves it touches by descending the tree, re-encodes those leaves only, with the leaf before them when the edit
reaches the two characters on which the cut between them hangs, and updates the sums above. The count of the whole
document is the root's sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geostrata.llm.common import ship, text_of
from geostrata.llm.tokens import CUT, Encoder, default_tokenizer, encoder

LEAF = 512
EDIT = "struct<start:int,removed:int,inserted:string>"


def leaves_of(text: str, leaf: int = LEAF) -> list[str]:
    """The text in leaves of ``leaf`` characters or a little more; the empty text is one empty leaf."""
    out, run, size = [], [], 0
    for piece in CUT.split(text):
        run.append(piece)
        size += len(piece)
        if size >= leaf:
            out.append("".join(run))
            run, size = [], 0
    if run or not out:
        out.append("".join(run))
    return out


class Tree:
    """Sums of (characters, tokens) over leaves, in one array: node i has the children 2i and 2i + 1."""

    def __init__(self, leaves: np.ndarray):
        self.width = 1 << max(0, int(len(leaves) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width:self.width + len(leaves)] = leaves
        for i in range(self.width - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def total(self) -> np.ndarray:
        return self.sums[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last leaf with characters for the end) and its first character."""
        node, begin = 1, 0
        at = max(0, min(at, int(self.sums[1, 0]) - 1))
        while node < self.width:
            left = int(self.sums[2 * node, 0])
            node *= 2
            if at - begin >= left:
                begin += left
                node += 1
        return node - self.width, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        self.sums[node] = chars, tokens
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]


def build(text: str, enc: Encoder) -> Tree:
    return Tree(np.array([(len(s), len(enc.encode(s)) // 4) for s in leaves_of(text)], np.int64))


def edit(text: str, tree: Tree, start: int, removed: int, inserted: str, enc: Encoder) -> tuple[str, Tree, int]:
    """The edited text, its tree, and how many characters were encoded again.

    ``start`` and ``removed`` are clipped to the text. The touched leaves become one; when it grows beyond four
    leaves' size the tree is laid out anew from the leaf sums, without encoding more than the touched part.
    """
    start = max(0, min(start, len(text)))
    removed = max(0, min(removed, len(text) - start))
    new = text[:start] + inserted + text[start + removed:]
    first, begin = tree.find(start)
    if first and start < begin + 2:  # the cut before this leaf hangs on its first two characters
        first, begin = tree.find(begin - 1)
    last, last_begin = tree.find(max(start, start + removed - 1))
    end = last_begin + int(tree.sums[tree.width + last, 0])
    last, end = max(last, first), max(end, begin)
    region = new[begin:end + len(inserted) - removed]
    parts = leaves_of(region)
    if len(region) <= 4 * LEAF:
        tree.put(first, len(region), len(enc.encode(region)) // 4)
        for leaf in range(first + 1, last + 1):
            tree.put(leaf, 0, 0)
        return new, tree, len(region)
    old = tree.sums[tree.width:]
    fresh = np.array([(len(s), len(enc.encode(s)) // 4) for s in parts], np.int64)
    kept = np.concatenate([old[:first], fresh, old[last + 1:]])
    kept = kept[kept[:, 0] > 0]
    return new, Tree(kept if len(kept) else np.zeros((1, 2), np.int64)), len(region)


def _state_type(doc_id: T.DataType) -> T.StructType:
    long_array = T.ArrayType(T.LongType())
    return T.StructType([
        T.StructField("doc_id", doc_id), T.StructField("text", T.StringType()),
        T.StructField("chars", long_array), T.StructField("tokens", long_array)])


def counted(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The state to keep, ``(doc_id, text, chars, tokens)``: the tree's sums as arrays; ``tokens[1]`` is the count.

    A null text counts as empty and has no tokens. Null or repeated ids and repeated rows have a state each; other
    columns are not read; an empty table gives no rows.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            trees = [build(t.as_py(), enc).sums for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(_lists([t[:, i] for t in trees]) for i in (0, 1))], ["doc_id", "text", "chars", "tokens"])

    ship(docs.sparkSession)
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, _state_type(docs.schema["doc_id"].dataType))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64), pa.int64()))


def edited(state: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The next state and ``tokens_before, tokens_after, encoded_chars, leaves`` from ``state`` with a column ``edits``.

    ``edits`` is an array of ``(start, removed, inserted)``, applied in order; null or empty leaves the document as
    it is; a null ``inserted`` inserts nothing.
    """
    path = tokenizer or default_tokenizer()
    base = _state_type(state.schema["doc_id"].dataType)
    more = [T.StructField(n, T.LongType()) for n in ("tokens_before", "tokens_after", "encoded_chars", "leaves")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts, trees, figures = [], [], []
            for i in range(batch.num_rows):
                text, chars, tokens, edits = (batch.column(c)[i] for c in range(1, 5))
                tree = Tree(np.zeros((1, 2), np.int64))
                tree.sums = np.stack([chars.values.to_numpy(), tokens.values.to_numpy()], 1).copy()
                tree.width = len(tree.sums) // 2
                text, before, again = text.as_py(), int(tree.total[1]), 0
                for e in edits.as_py() or []:
                    text, tree, n = edit(text, tree, e["start"] or 0, e["removed"] or 0, e["inserted"] or "", enc)
                    again += n
                texts.append(text), trees.append(tree.sums)
                figures.append((before, int(tree.total[1]), again, int((tree.sums[tree.width:, 0] > 0).sum())))
            figure = np.array(figures, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), *(_lists([t[:, i] for t in trees]) for i in (0, 1)), *(pa.array(figure[:, i]) for i in range(4))],
                [f.name for f in [*base, *more]])

    ship(state.sparkSession)
    return state.select("doc_id", "text", "chars", "tokens", "edits").mapInArrow(run, T.StructType([*base, *more]))


def with_edits(state: DataFrame, edits: DataFrame) -> DataFrame:
    """``state`` with the edits ``(doc_id, seq, start, removed, inserted)`` of each document in order of ``seq``.

    A document's edits come together because each shifts the next one's place.
    """
    one = F.struct("seq", F.col("start").cast("int").alias("start"), F.col("removed").cast("int").alias("removed"), "inserted")
    lists = edits.groupBy(F.col("doc_id").alias("id")).agg(F.sort_array(F.collect_list(one)).alias("all"))
    lists = lists.select("id", F.transform("all", lambda e: e.dropFields("seq")).alias("edits"))
    return state.join(lists, state["doc_id"] == lists["id"], "left").drop("id")


def sample_edits(text: Column, seed: int = 42) -> Column:
    """Three edits of a text at places that a hash of it decides: an insertion, a deletion and a replacement."""
    n = F.length(text)
    at = lambda i: F.pmod(F.xxhash64(F.lit(seed + i), text), F.greatest(n + F.lit(1), F.lit(1))).cast("int")
    return F.array(
        F.struct(at(0).alias("start"), F.lit(0).alias("removed"), F.lit(" newly inserted words").alias("inserted")),
        F.struct(at(1).alias("start"), F.lit(12).alias("removed"), F.lit("").alias("inserted")),
        F.struct(at(2).alias("start"), F.lit(8).alias("removed"), F.lit("x y").alias("inserted")))
