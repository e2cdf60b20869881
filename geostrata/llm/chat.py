"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A line is in one of six states: the beginning or the inside of a turn of system, user or assistant. It is observed
through its speaker marker ("Human:", "[assistant]", ...), whether a new row or a blank line precedes it, its length
and its closing question mark. Parameters are counted over rows with known roles; Viterbi recovers the states.

A conversation is decoded in segments of bounded size. A segment's best scores from every entering to every leaving
state form a small matrix; matrices of one conversation are chained, which fixes the states between segments, and
each segment is then decoded on its own. The result is that of one pass over the whole conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import ship
from geostrata.session import cut

ROLES = ("system", "user", "assistant")
STATES = [(r, b) for r in range(3) for b in (True, False)]  # (role, begins a turn)
K = len(STATES)
# fixed values: names that transcripts use for the roles
NAMES = {
    "system": 0, "instruction": 0, "instructions": 0, "context": 0,
    "user": 1, "human": 1, "q": 1, "question": 1, "customer": 1, "prompter": 1,
    "assistant": 2, "ai": 2, "bot": 2, "a": 2, "answer": 2, "agent": 2, "gpt": 2, "chatgpt": 2, "model": 2,
}
MARKER = re.compile(r"^[\s#*\[(<|]*([A-Za-z]{1,12})[\])>|*]*\s*(?::|：|>|\|>)\s*")
LENGTHS = (1, 41, 121, 401)
WIDTHS = (4, 2, len(LENGTHS) + 1, 2)  # values of marker, break, length, question
SEGMENT_TURNS, SEGMENT_ROWS = 4096, 8192


def observe(lines: list[str], new_row: bool = True) -> np.ndarray:
    """A row of four feature values per line."""
    out = np.zeros((len(lines), 4), np.int64)
    blank = new_row
    for i, line in enumerate(lines):
        m = MARKER.match(line)
        role = NAMES.get(m[1].lower()) if m else None
        bare = line.strip()
        out[i] = 0 if role is None else role + 1, blank, sum(len(bare) >= n for n in LENGTHS), bare[-1:] in ("?", "？")
        blank = not bare
    return out


def count_row(counts: dict, role: int, seen: np.ndarray, before: int | None) -> None:
    """Add a row of known role, after a row of role ``before`` (None: first of its conversation)."""
    states = np.array([2 * role] + [2 * role + 1] * (len(seen) - 1))
    for f in range(4):
        np.add.at(counts["emit"][f], (states, seen[:, f]), 1)
    counts["first" if before is None else "turn"][(role,) if before is None else (before, role)] += 1
    counts["stay"][role] += len(seen) - 1
    counts["end"][role] += 1


def no_counts() -> dict:
    return {"emit": [np.zeros((K, w)) for w in WIDTHS], "first": np.zeros(3), "turn": np.zeros((3, 3)), "stay": np.zeros(3), "end": np.zeros(3)}


def flat(counts: dict) -> np.ndarray:
    return np.concatenate([np.ravel(x) for x in [*counts["emit"], counts["first"], counts["turn"], counts["stay"], counts["end"]]])


def unflat(values: np.ndarray) -> dict:
    out, at = no_counts(), 0
    for x in [*out["emit"], out["first"], out["turn"], out["stay"], out["end"]]:
        x[...] = values[at:at + x.size].reshape(x.shape)
        at += x.size
    return out


class Model:
    """Log probabilities. What is known of markers beforehand is mixed in, as labelled rows may have none."""

    def __init__(self, counts: dict):
        norm = lambda x: (x + 0.5) / (x + 0.5).sum(-1, keepdims=True)
        emit = [norm(x) for x in counts["emit"]]
        known = np.full((K, 4), 0.005)
        breaks = np.empty((K, 2))
        for s, (role, begins) in enumerate(STATES):
            known[s, 0] = 0.4 if begins else 0.99
            if begins:
                known[s, role + 1] = 0.59
            breaks[s] = (0.5, 0.5) if begins else (0.9, 0.1)
        emit[0] = 0.5 * emit[0] + 0.5 * known / known.sum(1, keepdims=True)
        emit[1] = 0.9 * emit[1] + 0.1 * breaks
        self.emit = [np.log(e) for e in emit]
        stay = (counts["stay"] + 1) / (counts["stay"] + counts["end"] + 2)
        turn = norm(counts["turn"])
        self.step = np.full((K, K), -np.inf)
        for s, (role, _) in enumerate(STATES):
            self.step[s, 2 * role + 1] = np.log(stay[role])
            for r in range(3):
                self.step[s, 2 * r] = np.log((1 - stay[role]) * turn[role, r])
        self.start = np.full(K, -np.inf)
        self.start[::2] = np.log(norm(counts["first"]))

    def scores(self, seen: np.ndarray) -> np.ndarray:
        return sum(self.emit[f][:, seen[:, f]].T for f in range(4))

    def matrix(self, seen: np.ndarray) -> np.ndarray:
        """Best score from each entering state (last: the start) to each leaving state."""
        e = self.scores(seen)
        best = np.vstack([self.step, self.start]) + e[0]
        for row in e[1:]:
            best = (best[:, :, None] + self.step[None]).max(1) + row
        return best

    def decode(self, seen: np.ndarray, enter: int = K, leave: int | None = None) -> np.ndarray:
        """Best states, entering from state ``enter`` (K: the start) and ending in ``leave`` if given."""
        e = self.scores(seen)
        back = np.zeros((len(e), K), np.int64)
        best = np.vstack([self.step, self.start])[enter] + e[0]
        for i in range(1, len(e)):
            way = best[:, None] + self.step
            back[i] = way.argmax(0)
            best = way.max(0) + e[i]
        path = np.empty(len(e), np.int64)
        path[-1] = int(best.argmax()) if leave is None else leave
        for i in range(len(e) - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path


def turns_of(lines: list[str], path: np.ndarray) -> list[tuple[str, str]]:
    """Lines of a row as canonical turns (role, text without marker)."""
    out: list[tuple[str, list[str]]] = []
    for i, (line, state) in enumerate(zip(lines, path.tolist())):
        role, begins = STATES[state]
        if begins or not out:
            m = MARKER.match(line)
            if m and NAMES.get(m[1].lower()) == role:
                line = line[m.end():]
            out.append((ROLES[role], [line]))
        else:
            out[-1][1].append(line)
    return [(r, "\n".join(x)) for r, x in out]


def rendered(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>"


def segmented(rows: DataFrame) -> DataFrame:
    """Rows with ``cid`` (never null: a row without conversation is one of its own), ``seg`` and an order in it.

    A segment is a stretch of turns; a crowded stretch is split by turn, and rows of one turn by their hash, which
    orders them; more than ``SEGMENT_ROWS`` equal rows of a turn are dealt over segments of their own. Written once, so
    that a row keeps its number.
    """
    mark = F.xxhash64(F.col("turn"), F.col("text"), F.col("role"))
    alone = F.concat(F.lit("r"), F.hex(mark), F.lit("-"), F.coalesce(F.col("turn").cast("string"), F.lit("")))
    named = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    number = F.monotonically_increasing_id()
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1))
    base = cut(rows.select(
        "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), turn.alias("t"), mark.alias("mark"), number.alias("number"),
        F.coalesce(named, F.concat(alone, F.lit("-"), number.cast("string"))).alias("cid"), F.xxhash64(F.coalesce(named, alone)).alias("fold")))
    base = base.withColumn("stretch", F.floor(F.col("t") / SEGMENT_TURNS))
    sizes = base.groupBy(F.col("cid").alias("c"), F.col("stretch").alias("s")).agg(F.count("*").alias("n"))
    full = cut(sizes.where(F.col("n") > SEGMENT_ROWS).withColumn("parts", F.ceil(F.col("n") / SEGMENT_ROWS)).drop("n"))
    base = base.join(full, (F.col("cid") == F.col("c")) & (F.col("stretch") == F.col("s")), "left").drop("c", "s")
    equal = base.where("parts IS NOT NULL").groupBy(F.col("cid").alias("c"), F.col("t").alias("e_t"), F.col("mark").alias("e_mark")).agg(F.count("*").alias("n"))
    crowds = cut(equal.where(F.col("n") > SEGMENT_ROWS).withColumn("subs", F.ceil(F.col("n") / SEGMENT_ROWS)).drop("n"))
    base = base.join(crowds, (F.col("cid") == F.col("c")) & (F.col("t") == F.col("e_t")) & (F.col("mark") == F.col("e_mark")), "left").drop("c", "e_t", "e_mark")
    part = F.floor(F.shiftrightunsigned(F.col("mark"), 33) * F.col("parts") / F.lit(float(1 << 31)))
    split = F.col("parts").isNotNull()
    sub = F.coalesce(F.pmod(F.xxhash64("number"), F.col("subs")) + 1, F.lit(0))  # equal rows come behind the others of their part
    seg = F.struct("stretch", F.when(split, F.col("t")).otherwise(0).alias("turn"), F.when(split, part).otherwise(0).alias("part"), sub.alias("sub"))
    return base.withColumn("seg", seg).withColumn("place", F.shiftrightunsigned(F.col("mark"), 33)).drop("parts", "subs")


ORDER = ("cid", "seg", "t", "place", "mark", "number")


def _segments(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]):
    """Runs of equal (cid, seg) over the batches of a sorted partition: lists of tuples of ``columns``."""
    def rows():
        for batch in batches:
            table = [batch.column(c).to_pylist() for c in ("key", *columns)]
            yield from zip(*table)

    for _, run in groupby(rows(), key=lambda r: r[0]):
        yield list(run)


def _key():
    return F.concat_ws("/", "cid", "seg.stretch", "seg.turn", "seg.part", "seg.sub").alias("key")


def fit(rows: DataFrame) -> Model:
    """Counts over rows with a known role, without every fifth conversation; only the sums reach the driver."""
    roles = F.create_map(*[x for n, r in NAMES.items() for x in (F.lit(n), F.lit(r))])
    known = rows.select("cid", "seg", "t", "place", "mark", "number", "fold", "text", F.get(F.array(roles[F.lower("role")]), F.lit(0)).alias("known"))
    known = known.where(F.col("known").isNotNull() & (F.pmod("fold", F.lit(5)) != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = no_counts()
        for segment in _segments(batches, ("text", "known")):
            before = None
            for _, text, role in segment:
                count_row(counts, role, observe(text.split("\n")), before)
                before = role
        values = flat(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["place", "value"])

    ordered = known.repartition("cid", "seg").sortWithinPartitions(*ORDER).select(_key(), "text", "known")
    sums = ordered.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()  # 94 numbers
    values = np.zeros(len(flat(no_counts())))
    for r in sums:
        values[r["place"]] = r["value"]
    return Model(unflat(values))


def _borders(rows: pa.Table) -> pa.Table:
    """Entering and leaving state of each segment of one conversation, from the segments' matrices."""
    rows = rows.sort_by([(c, "ascending") for c in ("stretch", "turn", "part", "sub")])
    mats = np.array(rows["matrix"].to_pylist()).reshape(-1, K + 1, K)
    best, ways = mats[0][K], []
    for m in mats[1:]:
        way = best[:, None] + m[:K]
        ways.append(way.argmax(0))
        best = way.max(0)
    leave = np.empty(len(mats), np.int64)
    leave[-1] = best.argmax()
    for i in range(len(mats) - 1, 0, -1):
        leave[i - 1] = ways[i - 1][leave[i]]
    return pa.table({"b_key": rows["key"], "enter": pa.array([K, *leave[:-1].tolist()], pa.int64()), "leave": pa.array(leave)})


def formatted(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, part, given, role, rendered)``: recovered turns of every row of ``conversations``.

    ``given`` is the row's own role, which decoding never reads. A row whose lines hold several speakers becomes
    several parts. Rows of a conversation are ordered by turn (null first), rows of one turn by a hash; repeated
    rows are turns of their own. A null text is one empty line. Rows with a null ``conv_id`` are conversations of
    their own. Without any known role the prior alone decides. Other columns are not read; an empty table gives
    no rows.
    """
    ship(conversations.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in conversations.schema.fields}
    rows = segmented(conversations.select("conv_id", "turn", "role", "text"))
    model = fit(rows)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment in _segments(batches, ("cid", "stretch", "turn", "part", "sub", "text")):
            seen = np.vstack([observe(s[-1].split("\n")) for s in segment])
            first = segment[0]
            yield pa.RecordBatch.from_pydict({
                "key": [first[0]], "cid": [first[1]], "stretch": pa.array([first[2]], pa.int64()), "turn": pa.array([first[3]], pa.int64()),
                "part": pa.array([first[4]], pa.int64()), "sub": pa.array([first[5]], pa.int64()), "matrix": pa.array([model.matrix(seen).ravel().tolist()], pa.list_(pa.float64()))})

    # only conversations of several segments need their borders
    several = rows.groupBy("cid").agg(F.min("seg").alias("lo"), F.max("seg").alias("hi")).where("lo <> hi").select(F.col("cid").alias("long_cid"))
    long_rows = rows.join(several, F.col("cid") == F.col("long_cid"), "left_semi").repartition("cid", "seg").sortWithinPartitions(*ORDER)
    parts = long_rows.select(_key(), "cid", "seg.stretch", "seg.turn", "seg.part", "seg.sub", "text").mapInArrow(
        summed, "key string, cid string, stretch long, turn long, part long, sub long, matrix array<double>")
    borders = cut(parts.groupBy("cid").applyInArrow(_borders, "b_key string, enter long, leave long"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch_rows in _bundles(_segments(batches, ("conv_id", "turn", "role", "text", "enter", "leave")), 2000):
            out = []
            for segment in batch_rows:
                lines = [s[4].split("\n") for s in segment]
                seen = np.vstack([observe(x) for x in lines])
                enter, leave = segment[0][5], segment[0][6]
                path = model.decode(seen, K if enter is None else enter, leave)
                at = 0
                for s, x in zip(segment, lines):
                    for part, (role, text) in enumerate(turns_of(x, path[at:at + len(x)])):
                        out.append((s[1], s[2], part, s[3], role, rendered(role, text)))
                    at += len(x)
            names = ("conv_id", "turn", "part", "given", "role", "rendered")
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), types)], names)

    import pyspark.sql.pandas.types as pt
    types = [pt.to_arrow_type(conversations.schema["conv_id"].dataType), pt.to_arrow_type(conversations.schema["turn"].dataType), pa.int32(), pa.string(), pa.string(), pa.string()]
    keyed = rows.withColumn("key", _key()).join(borders, F.col("key") == F.col("b_key"), "left")
    ordered = keyed.repartition("cid", "seg").sortWithinPartitions(*ORDER)
    return ordered.select("key", "conv_id", "turn", F.col("role").cast("string").alias("role"), "text", "enter", "leave").mapInArrow(
        decoded, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, part int, given string, role string, rendered string")


def _bundles(segments, rows: int):
    """Lists of segments with about ``rows`` rows."""
    held, n = [], 0
    for s in segments:
        held.append(s)
        n += len(s)
        if n >= rows:
            yield held
            held, n = [], 0
    if held:
        yield held
