"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics. Per class the mean and a covariance shrunk towards the
pooled covariance and a multiple of the identity are fitted from sums that Spark adds up; the Cholesky factors are
computed once and every document is scored by the difference of the two Gaussian log densities.

The fit reads at most ``FIT_ROWS`` labelled documents, those with the smallest hash of their id; every document is
scored on its whole text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geostrata.llm.common import mapped, ship, text_of

FEATURES = (
    "log_words", "log_word_length", "word_length_spread", "new_words", "upper", "digits", "marks", "odd_marks", "top_mark",
    "marked_words", "line_length", "new_lines", "top_line", "entropy", "compressed", "other_bytes", "top_word",
)
_UPPER, _LOWER, _DIGIT, _SPACE, _MARK, _PLAIN = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_SPACE[[32, *range(9, 14)]] = True
_MARK[33:127] = True
_MARK &= ~(_UPPER | _LOWER | _DIGIT)
_PLAIN[[ord(c) for c in ".,;:'\"-()?"]] = True
FIT_ROWS = 50_000


def statistics(text: str) -> list[float]:
    """The features of one text. All are finite, also for texts without words."""
    raw = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    total = max(1, len(raw))
    letters = int(count[_UPPER].sum() + count[_LOWER].sum() + count[128:].sum())
    marks = int(count[_MARK].sum())
    odd = int(count[_MARK & ~_PLAIN].sum())
    words = text.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    different: dict[str, int] = {}
    for w in words:
        different[w] = different.get(w, 0) + 1
    marked = sum(k for w, k in different.items() if not w[-1].isalnum() and w[-1] not in ".,;:")
    lines: dict[str, int] = {}
    for line in text.split("\n"):
        lines[line] = lines.get(line, 0) + 1
    n_lines = sum(lines.values())
    share = count[count > 0] / total
    packed_size = len(zlib.compress(raw, 1))
    return [
        math.log1p(n), math.log1p(float(lengths.mean())), math.log1p(float(lengths.std())),
        math.log1p(len(different)) - math.log1p(n), math.sqrt(int(count[_UPPER].sum()) / max(1, letters)),
        math.sqrt(int(count[_DIGIT].sum()) / total), math.sqrt(marks / total), math.sqrt(odd / total),
        math.sqrt(int(count[_MARK].max()) / total), math.sqrt(marked / max(1, n)),
        math.log1p(n / n_lines), math.log1p(len(lines)) - math.log1p(n_lines),
        math.sqrt(max(k * len(s) for s, k in lines.items()) / max(1, len(text))) if n_lines > 1 else 0.0,
        float(-(share * np.log2(share)).sum()), math.log1p(packed_size) - math.log1p(len(raw)),
        math.sqrt(int(count[128:].sum()) / total), math.sqrt(max(different.values(), default=0) / max(1, n)),
    ]


def is_held_out() -> Column:
    """One document in five, by the checksum of its id as text (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class Model:
    """Per class mean, inverse of the covariance's Cholesky factor, and log prior less log determinant."""

    mean: np.ndarray
    whiten: np.ndarray
    offset: np.ndarray
    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1. With one class only there is nothing to tell apart: its share."""
        if not len(self.mean):
            return np.full(len(x), self.share)
        density = [o - 0.5 * (((x - m) @ w.T) ** 2).sum(1) for m, w, o in zip(self.mean, self.whiten, self.offset)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def model_of(sums: dict[int, np.ndarray], pooled: float, ridge: float) -> Model:
    """Model from each class's sums of (1, x)(1, x)^T."""
    n = {c: s[0, 0] for c, s in sums.items()}
    if min(n.get(0, 0), n.get(1, 0)) < 2:
        total = n.get(0, 0) + n.get(1, 0)
        return Model(np.empty(0), np.empty(0), np.empty(0), float(n.get(1, 0) / total) if total else 0.5)
    mean = {c: sums[c][0, 1:] / n[c] for c in (0, 1)}
    scatter = {c: sums[c][1:, 1:] - n[c] * np.outer(mean[c], mean[c]) for c in (0, 1)}
    total = n[0] + n[1]
    common = (scatter[0] + scatter[1]) / total
    scale = np.sqrt(np.maximum(np.diag(common), 1e-9))
    whiten, offset = [], []
    for c in (0, 1):
        cov = (1 - pooled) * scatter[c] / n[c] + pooled * common
        cov = cov / np.outer(scale, scale)
        cov = (1 - ridge) * cov + ridge * np.eye(len(cov)) * max(np.trace(cov) / len(cov), 1e-6)
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor) / scale)
        offset.append(math.log(n[c] / total) - np.log(np.diag(factor)).sum())
    return Model(np.array([mean[0], mean[1]]), np.array(whiten), np.array(offset), float(n[1] / total))


def labelled(labels: DataFrame, fit_rows: int) -> DataFrame:
    """``(id, quality)`` to learn from: one row per id, no contradicting labels, none held out."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out())
    one = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("other"))
    one = one.where("quality = other").select(F.col("doc_id").alias("id"), "quality")
    return one.orderBy(F.xxhash64("id"), "id").limit(fit_rows)


def fit(docs: DataFrame, labels: DataFrame, pooled: float = 0.6, ridge: float = 0.01, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``fit_rows`` labelled ids, which are broadcast; only sums per class reach the driver."""
    ship(docs.sparkSession)
    wide = len(FEATURES) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, wide, wide))
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                x = np.array([1.0, *statistics(text.as_py())])
                sums[label] += np.outer(x, x)
        label, place = np.divmod(np.arange(2 * wide * wide), wide * wide)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(place), pa.array(sums.ravel())], ["label", "place", "value"])

    known = F.broadcast(labelled(labels, fit_rows))  # at most fit_rows rows
    rows = docs.join(known, docs["doc_id"] == known["id"]).select(text_of().alias("text"), known["quality"])
    added = mapped(rows, run, "label long, place long, value double").groupBy("label", "place").agg(F.sum("value").alias("value"))
    sums = {c: np.zeros(wide * wide) for c in (0, 1)}
    for r in added.collect():  # 2 x 18 x 18 numbers
        sums[r["label"]][r["place"]] = r["value"]
    return model_of({c: v.reshape(wide, wide) for c, v in sums.items()}, pooled, ridge)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every row of ``docs``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", text_of().alias("text")), run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row.

    Null, empty and repeated texts are scored like any other; null or repeated ids give a row each. Without
    labels of both kinds every score is the share of label 1 (0.5 without any). Columns beside ``doc_id`` and
    ``text`` are not read; an empty table gives no rows.
    """
    rows = scored(docs, fit(docs, labels, **how))
    return rows.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more; rows pass through the scoring, so nothing is joined.

    A text that is a string already goes to the tasks once, inside its row.
    """
    model = fit(docs, labels, **how)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    inside = [i for i, f in enumerate(docs.schema) if f.name == "text" and f.dataType == T.StringType()]
    rows = docs.select(whole, *([] if inside else [text_of().alias("text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(inside[0]) if inside else batch.column(1)
            x = np.array([statistics(t.as_py() or "") for t in texts]).reshape(-1, len(FEATURES))
            kept = batch.column(0).filter(pa.array(model.scores(x) >= threshold))
            yield pa.RecordBatch.from_arrays([kept], ["row"])

    return mapped(rows, run, T.StructType([rows.schema["row"]])).select("row.*")

