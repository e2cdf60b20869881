"""Repair of conversation structure: the cheapest edits that leave turns in a legal order.

Legal role initials are ``(s?(ua)+)?``. Read from the left they pass four states: nothing yet, after a leading s, after
a u, after an a; the first and the last may end. An edit of a row (with insertions before it) leads from state to state
at a cost, so a row is a table of 4 x 4 costs, and so is a run of rows. Of equally cheap edits the ASCII-least string of
their initials counts. Strings over the same rows that end in different states never continue each other, so beside
each cost only the order of the four strings is carried, not the strings.

Reconstruction is Hirschberg's: a forward vector of four costs (with the order of their strings) and a backward vector
meet in the middle, the best crossing state (of equal ones the least string) is fixed, and both halves are solved the
same way. Long conversations are split over tasks likewise: every 4096 rows make one table, tables of successive pieces are
multiplied up to one per conversation, and crossings are handed down again. No task holds a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import SPACE, ship
from geostrata.session import cut

STATES, NEVER = 4, 1 << 60
INITIALS = "sua"  # other initials count as the fourth kind
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})  # by state, where an emitted initial leads
NAMES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = {("s", "u"), ("u", "a"), ("a", "u")}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
RUN_BITS, FAN = 12, 4096
CLOSING = (0, 2, 1, 0)  # insertions that end a conversation from each state
INSERT = 5

Table = tuple[Sequence[int], Sequence[int]]  # costs and, by entry, the order of the strings; index 4 * entry + exit


def _insertions(state: int) -> Iterator[tuple[int, list[str]]]:
    """States reachable by insertions without passing one twice."""
    at, seen, roles = state, {state}, []
    yield at, []
    while True:
        initial = "a" if at == 2 else "u"
        at = AFTER[at][initial]
        if at in seen:
            return
        seen.add(at)
        roles = [*roles, NAMES[initial]]
        yield at, roles


def _edits(fault: int, initial: str) -> list[list[tuple | None]]:
    """By entry and exit, ``(cost, letters, inserted roles, new role)`` of the best way over one row."""
    best: list[list[tuple | None]] = [[None] * STATES for _ in range(STATES)]
    more = 5 if fault == TRUNCATED else 0
    for entry in range(STATES):
        for at, roles in _insertions(entry):
            ways = [(2, "D", None, at)]
            if fault in (FINE, TRUNCATED):
                ways += [(more, "K", None, AFTER[at][initial])] if initial in AFTER[at] else []
                ways += [(1 + more, "R", NAMES[x], to) for x, to in AFTER[at].items() if x in NAMES]
            for cost, letter, role, to in ways:
                way = (cost + INSERT * len(roles), "I" * len(roles) + letter, roles, role)
                if best[entry][to] is None or way[:2] < best[entry][to][:2]:
                    best[entry][to] = way
    return best


def _table(best: list[list[tuple | None]]) -> Table:
    costs = [NEVER if way is None else way[0] for row in best for way in row]
    order = []
    for row in best:
        known = sorted(way[1] for way in row if way)
        order += [known.index(way[1]) if way else STATES for way in row]
    return costs, order


EDITS = [_edits(fault, initial) for fault, initial in product(range(4), [*INITIALS, "?"])]
TABLES = [_table(best) for best in EDITS]
NOTHING: Table = ([0 if i == j else NEVER for i in range(STATES) for j in range(STATES)], [0 if i == j else STATES for i in range(STATES) for j in range(STATES)])


def step(costs: list[int], order: list[int], table: Table) -> tuple[list[int], list[int]]:
    """A forward vector moved over one table: costs, and the order of the least strings behind them."""
    more, inner = table
    best = [min((costs[p] + more[STATES * p + q], order[p], inner[STATES * p + q]) for p in range(STATES)) for q in range(STATES)]
    known = sorted(b[1:] for b in best if b[0] < NEVER)
    return [min(b[0], NEVER) for b in best], [known.index(b[1:]) if b[0] < NEVER else STATES for b in best]


def start_at(state: int) -> tuple[list[int], list[int]]:
    return NOTHING[0][STATES * state:STATES * state + STATES], NOTHING[1][STATES * state:STATES * state + STATES]


def chained(tables: Sequence[Table]) -> Table:
    """One table for a run of tables."""
    costs, order = [], []
    for entry in range(STATES):
        vector = start_at(entry)
        for table in tables:
            vector = step(*vector, table)
        costs += vector[0]
        order += vector[1]
    return costs, order


def back(table: Table, costs: list[int]) -> list[int]:
    """A backward vector moved over one table."""
    return [min(NEVER, min(table[0][STATES * p + q] + costs[q] for q in range(STATES))) for p in range(STATES)]


def crossings(tables: Sequence[Table], entry: int, leave: int) -> list[int]:
    """States before, between and behind the tables on the best way from ``entry`` to ``leave``."""
    states = [entry] + [leave] * len(tables)
    todo = [(0, len(tables))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        ahead, behind = start_at(states[lo]), start_at(states[hi])[0]
        for table in tables[lo:mid]:
            ahead = step(*ahead, table)
        for table in reversed(tables[mid:hi]):
            behind = back(table, behind)
        states[mid] = min(range(STATES), key=lambda s: (ahead[0][s] + behind[s], ahead[1][s]))
        todo += [(lo, mid), (mid, hi)]
    return states


def final_state(table: Table) -> int:
    return min(range(STATES), key=lambda q: (table[0][q] + INSERT * CLOSING[q], table[1][q]))


def illegal_pairs(initials: Sequence[str]) -> int:
    return sum((a, b) not in LEGAL_PAIRS for a, b in zip(initials, initials[1:]))


def marked(turns: DataFrame) -> DataFrame:
    """``(conv, conv_id, turn, role, text, pos, kind)`` of every row, in order of ``pos``.

    Rows of a conversation follow by turn, nulls first, then by role and text. ``conv`` names the conversation, also
    where ``conv_id`` is null. ``kind`` is the first fault times four plus the kind of the role's initial.
    """
    blank = f"[^{SPACE}]"
    order = ["conv", "turn", "role", "text", "again"]
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), "conv_id", "turn",
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("again"))  # so that equal rows spread
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()).drop("again"))
    seen = placed.groupBy("conv", "role", F.sha2("text", 256).alias("h")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    letter = F.substring("role", 1, 1)
    initial = F.coalesce(*[F.when(letter == x, F.lit(i)) for i, x in enumerate(INITIALS)], F.lit(len(INITIALS)))
    ends = F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    fault = F.when(~F.col("text").rlike(blank), BLANK).when(F.col("first").isNull(), DUPLICATE).when(~ends, TRUNCATED).otherwise(FINE)
    return placed.join(seen, "pos", "left").select("conv", "conv_id", "turn", "role", "text", "pos", (fault * 4 + initial).cast("int").alias("kind"))


RUN = "costs array<long>, ranks array<int>, illegal long, head int, tail int"


def _summary(tables: Sequence[Table], illegal: int, head: int, tail: int) -> tuple:
    costs, order = chained(tables)
    return list(costs), list(order), illegal, head, tail


def _of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for kinds in batch.column(2).to_pylist():
            initials = ["sua?"[k % 4] for k in kinds]
            out.append(_summary([TABLES[k] for k in kinds], illegal_pairs(initials), kinds[0] % 4, kinds[-1] % 4))
        yield _with(batch, out)


def _with(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.int32())
    arrays = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["conv", "node", "costs", "ranks", "illegal", "head", "tail"])


def _of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for runs in batch.column(2).to_pylist():
            between = sum(("sua?"[a["tail"]], "sua?"[b["head"]]) not in LEGAL_PAIRS for a, b in zip(runs, runs[1:]))
            tables = [(r["costs"], r["ranks"]) for r in runs]
            out.append(_summary(tables, between + sum(r["illegal"] for r in runs), runs[0]["head"], runs[-1]["tail"]))
        yield _with(batch, out)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tables = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
        leave = [final_state(t) for t in tables]
        cost = [t[0][q] + INSERT * CLOSING[q] for t, q in zip(tables, leave)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(3), batch.column(4), pa.array(cost, pa.int64()), pa.array([0] * len(leave), pa.int32()), pa.array(leave, pa.int32())],
            ["conv", "node", "illegal", "cost", "entry", "leave"])


def _handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States at the ends of each run of a node whose own ends are known."""
    for batch in batches:
        names, nodes, entries, leaves = [], [], [], []
        for conv, runs, entry, leave in zip(*(batch.column(i).to_pylist() for i in range(4))):
            states = crossings([(r["costs"], r["ranks"]) for r in runs], entry, leave)
            names += [conv] * len(runs)
            nodes += [r["node"] for r in runs]
            entries += states[:-1]
            leaves += states[1:]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(nodes, pa.int64()), pa.array(entries, pa.int32()), pa.array(leaves, pa.int32())], ["conv", "node", "entry", "leave"])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters, inserted roles and new role of every row of a run whose ends are known."""
    for batch in batches:
        place, letters, inserted, role = [], [], [], []
        for at, kinds, entry, leave in zip(*(batch.column(i).to_pylist() for i in range(4))):
            states = crossings([TABLES[k] for k in kinds], entry, leave)
            for pos, kind, p, q in zip(at, kinds, states, states[1:]):
                _, edit, roles, new = EDITS[kind][p][q]
                place.append(pos), letters.append(edit), inserted.append(roles), role.append(new)
        yield pa.RecordBatch.from_arrays(
            [pa.array(place, pa.int64()), pa.array(letters, pa.string()), pa.array(inserted, pa.list_(pa.string())), pa.array(role, pa.string())],
            ["pos", "edit", "inserted", "new_role"])


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(edits, roots)`` for rows of ``marked``: ``(pos, edit, inserted, new_role)`` of every row, and
    ``(conv, illegal, cost, closing)`` of every conversation, ``closing`` the insertions behind its last row."""
    ship(rows.sparkSession)
    runs = rows.groupBy("conv", F.shiftright("pos", RUN_BITS).alias("node")).agg(F.array_sort(F.collect_list(F.struct("pos", "kind"))).alias("all"))
    runs = cut(runs.select("conv", "node", F.col("all.kind").alias("kinds"), F.col("all.pos").alias("places")))  # at most 4096 rows each
    nodes = cut(runs.select("conv", "node", "kinds").mapInArrow(_of_rows, f"conv string, node long, {RUN}"))
    levels = []
    while (most := nodes.groupBy("conv").count().agg(F.max("count")).first()[0] or 0) > 1:
        parent = F.lit(0).cast("long") if most <= FAN else F.shiftright("node", RUN_BITS)
        grouped = cut(nodes.groupBy("conv", parent.alias("parent")).agg(
            F.array_sort(F.collect_list(F.struct("node", "costs", "ranks", "illegal", "head", "tail"))).alias("runs")))
        nodes = cut(grouped.mapInArrow(_of_runs, f"conv string, node long, {RUN}"))
        levels.append(grouped)
    roots = cut(nodes.select("conv", "costs", "ranks", "node", "illegal").mapInArrow(_roots, "conv string, node long, illegal long, cost long, entry int, leave int"))
    ends = roots.select("conv", "node", "entry", "leave")
    for grouped in reversed(levels):
        known = grouped.join(ends.withColumnRenamed("node", "parent"), ["conv", "parent"])
        ends = cut(known.select("conv", "runs", "entry", "leave").mapInArrow(_handed_down, "conv string, node long, entry int, leave int"))
    edits = runs.join(ends, ["conv", "node"]).select("places", "kinds", "entry", "leave").mapInArrow(
        _edited, "pos long, edit string, inserted array<string>, new_role string")
    closing = F.array(*[F.lit(n) for n in CLOSING])[F.col("leave")]
    return edits, roots.select("conv", "illegal", "cost", closing.alias("closing"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after a fixed damage, chosen by the checksum of ``conv_id:turn``: one in twenty each is dropped, emptied,
    loses its ``.!?``, is repeated, or becomes a user's. Null ids and turns count as a space there; null texts and roles become one."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(
        "conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
        (F.crc32(key.cast("binary")) % 20).alias("case"))
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("case") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("case <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")


def emitted(rows: DataFrame, edits: DataFrame, roots: DataFrame) -> DataFrame:
    """``(conv, pos, edit, turns array<struct<role, text>>)``: what each edit leaves, the closing insertions last."""
    empty = F.transform("inserted", lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    own = F.array(F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text")))
    turns = F.when(F.col("edit").endswith("D"), empty).otherwise(F.concat(empty, own))
    inside = rows.join(edits, "pos").select("conv", "pos", "edit", turns.alias("turns"))
    names = F.array(F.lit("user"), F.lit("assistant"))  # what closes is "ua" or its end
    last = F.transform(F.slice(names, F.lit(3) - F.col("closing"), F.col("closing")), lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    end = roots.where("closing > 0").select("conv", F.lit((1 << 63) - 1).alias("pos"), F.repeat(F.lit("I"), F.col("closing")).alias("edit"), last.alias("turns"))
    return inside.union(end)


def repaired(turns: DataFrame) -> DataFrame:
    """``(conv_id, place, edit, role, text)``: the turns left after the cheapest edits, ``place`` ascending inside a conversation.

    Rows are taken by turn, nulls first, then by role and text. Null roles and texts count as one space. Rows without a
    ``conv_id`` are one conversation. Blank rows and repeats of a role and text are deleted; so equal rows leave one.
    Other columns are not read. An empty table gives no rows.
    """
    rows = marked(turns)
    edits, roots = plan(rows)
    ids = rows.groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    out = emitted(rows, edits, roots).select("conv", "pos", "edit", F.posexplode("turns").alias("at", "turn"))
    return out.join(ids, "conv").select("conv_id", F.struct("pos", "at").alias("place"), "edit", "turn.role", "turn.text")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and checksum of each conversation, its rows read one after the other."""
    name, letters, digest, begun = None, [], None, False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"conv": [name], "audit": ["".join(letters)], "repaired_sha256": [digest.hexdigest()]})

    for batch in batches:
        for conv, edit, turns in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if conv != name:
                if name is not None:
                    yield row()
                name, letters, digest, begun = conv, [], hashlib.sha256(), False
            letters.append(edit)
            for turn in turns:
                digest.update(("\n" * begun + turn["role"] + ":" + turn["text"]).encode("utf-8"))
                begun = True
    if name is not None:
        yield row()


def audited(turns: DataFrame, all_ids: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``all_ids``: counts of faults, cost, audit and the checksum of the repaired turns.

    Conversations without rows have zeros, an empty audit and the checksum of nothing. The audit and checksum read a
    conversation's rows in order in one task, which holds the audit's letters only.
    """
    rows = marked(turns)
    edits, roots = plan(rows)
    fault = F.col("kind").bitwiseAND(F.lit(12))
    counts = rows.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(fault == 4 * i).alias(n) for i, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))])
    told = emitted(rows, edits, roots).repartition("conv").sortWithinPartitions("conv", "pos").select("conv", "edit", "turns").mapInArrow(
        _digests, "conv string, audit string, repaired_sha256 string")
    ids = all_ids.groupBy("conv_id").agg(F.lit(1)).select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), "conv_id")
    whole = ids.join(counts, "conv", "left").join(roots, "conv", "left").join(told, "conv", "left")
    numbers = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
