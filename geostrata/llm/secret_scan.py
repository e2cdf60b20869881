"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived that every match must satisfy: a run of
literals needs all its trigrams, alternatives need one of theirs. The index lists, for every trigram that some rule
asks for, the texts that hold it; postings are intersected and united per rule, and only candidate texts meet the
rule's expression. A rule without mandatory trigrams is run over every text.

Texts are named in the index by a hash of their content, so copies share their postings; a hash shared by different
texts only adds candidates, since every candidate is verified on its own text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import text_of
from geostrata.session import cut

_parser = re._parser  # the standard library's own reading of an expression
MOST_STRINGS = 64
MASK = "[REDACTED]"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# fixed values: the three base rules
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE

# ---- Boolean queries: a trigram, ("and", parts), ("or", parts); None asks for nothing


def _both(op: str, parts: list):
    if op == "or" and any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else (op, tuple(parts))


def _of_strings(strings: set[str]):
    """One of the strings is there: the trigrams of one are. A string that asks for more than another adds nothing."""
    needs = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    least = [n for n in needs if not any(m < n for m in needs)]
    return _both("or", [_both("and", sorted(n)) for n in sorted(least, key=sorted)])


def _read(node) -> tuple[set[str] | None, object]:
    """All strings a part can match (None: too many to list), and what every match must hold besides."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower()}, None
    if op == "IN" and all(str(k) == "LITERAL" for k, _ in arg):
        return {chr(v).lower() for _, v in arg}, None
    if op == "SUBPATTERN":
        return _sequence(arg[-1])
    if op == "BRANCH":
        sides = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in sides):
            union = set().union(*(s for s, _ in sides))
            if len(union) <= MOST_STRINGS:
                return union, None
        return None, _both("or", [_of_strings(s) if s is not None else q for s, q in sides])
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, body = arg
        strings, query = _sequence(body)
        if strings is not None and int(most) <= 1:
            return strings | ({""} if least == 0 else set()), None
        if strings is not None and least == most and len(strings) == 1:
            return {next(iter(strings)) * least}, None
        return None, None if least == 0 else (_of_strings(strings) if strings is not None else query)
    if op == "AT":
        return {""}, None
    return None, None


def _sequence(nodes) -> tuple[set[str] | None, object]:
    strings, exact, needs = {""}, True, []
    for node in nodes:
        own, query = _read(node)
        needs.append(query)
        if own is not None and len(strings) * len(own) <= MOST_STRINGS:
            strings = {a + b for a, b in product(strings, own)}
            continue
        # a repeat begins and ends with its body, so the body joins what stands before and after it
        body = _sequence(node[1][2])[0] if own is None and str(node[0]).endswith("_REPEAT") and node[1][0] >= 1 else None
        if body is not None and len(strings) * len(body) <= MOST_STRINGS:
            strings = {a + b for a, b in product(strings, body)}
        needs.append(_of_strings(strings))
        exact = False
        strings = own or body or {""}
    if exact:
        return strings, None
    return None, _both("and", [*needs, _of_strings(strings)])


def trigram_query(pattern: str):
    """The Boolean trigram query of an expression, over lower-cased text; None when nothing is mandatory."""
    strings, query = _sequence(_parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query


def trigrams_of(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(p) for p in query[1]))


def _holds(query, present: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(present, query)
    return reduce(Column.__and__ if query[0] == "and" else Column.__or__, [_holds(p, present) for p in query[1]])


# ---- index, candidates, verification


def text_key() -> Column:
    return F.xxhash64(text_of())


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index ``(trigram, text_key)`` of the trigrams that the rules ask for."""
    wanted = sorted(set().union(*(trigrams_of(trigram_query(r.pattern)) for r in rules)))
    rows = docs.select(text_key().alias("text_key"), F.lower(text_of()).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted])) if wanted else F.array().cast("array<string>")
    return rows.select(F.explode(held).alias("trigram"), "text_key").select("trigram", "text_key")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(text_key, may)``: bit i of ``may`` is set when the text satisfies rule i's query; texts with no bit are left out.

    A text's postings are at most the trigrams asked for, so a group is bounded.
    """
    present = index.groupBy("text_key").agg(F.collect_set("trigram").alias("present"))
    bits = [(1 << i, trigram_query(r.pattern)) for i, r in enumerate(rules)]
    may = reduce(Column.__add__, [F.when(_holds(q, F.col("present")), F.lit(b)).otherwise(F.lit(0)) for b, q in bits if q is not None], F.lit(0)).cast("long")
    return present.select("text_key", may.alias("may")).where("may > 0")


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """Spans of a rule's matches, leftmost and non-overlapping, in code points; too short ones are dropped.

    The pieces between matches and the matches alternate, so their lengths add up to the positions.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    both = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("hit"), judged.alias("judged"))
    kind = "array<struct<start:int,order:int,end:int,kind:string>>"

    def add(state: Column, m: Column) -> Column:
        start = state["at"] + F.length(m["gap"])
        end = start + F.coalesce(F.length(m["hit"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        found = F.when(F.length(m["judged"]) >= rule.least, F.concat(state["found"], one)).otherwise(state["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))
    return F.aggregate(both, start, add)["found"]


def found(docs: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast_rows: int = 500_000) -> DataFrame:
    """``(row, found)``: every row of ``docs`` and its spans by start, then rule; ``found`` is an array of structs.

    Candidates are broadcast while they number at most ``broadcast_rows`` (16 bytes each); beyond that the join
    shuffles the texts by their hash, and adaptive execution splits groups of copies.
    """
    may = cut(candidates(postings(docs, rules), rules))
    if may.count() <= broadcast_rows:
        may = F.broadcast(may)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_of().alias("text"), text_key().alias("text_key"))
    rows = rows.join(may, "text_key", "left")
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    spans = []
    for i, rule in enumerate(rules):
        if trigram_query(rule.pattern) is None:
            run = F.rlike(F.col("text"), F.lit(_at_least(rule)))
        else:
            run = F.coalesce(F.col("may").bitwiseAND(F.lit(1 << i)) > 0, F.lit(False))
        spans.append(F.when(run, _spans(rule, i, F.col("text"))).otherwise(none))
    return rows.select("row", F.array_sort(F.concat(*spans)).alias("found"))


def _at_least(rule: Rule) -> str:
    """A quick test that any match long enough passes: a closing + becomes the least number of repeats."""
    simple = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return f"{simple[1]}{{{rule.least}}}" if simple and not rule.group else rule.pattern


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(doc_id, n_<base kind>..., base_sha256, spans)`` of every row.

    A null text counts as empty and has no spans. Copies, repeated rows and null ids give a row each; other
    columns are not used; an empty table gives no rows.
    """
    base = F.filter("found", lambda s: s["order"] < len(BASE))
    of_kind = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(r.kind).alias(f"n_{r.kind}") for r in BASE]
    rows = found(docs.select("doc_id", "text"), rules)
    return rows.select("row.doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` with every span of ``text`` replaced by a mask; overlapping spans are one.

    ``n_chars``, where there is one, is set anew in rows that changed. Rows without spans are returned as they are.
    """
    text = F.col("row.text").cast("string")

    def hide(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        more = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(MASK))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, more).otherwise(state["out"]).alias("out"))

    hidden = F.aggregate("found", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), hide, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    rows = found(docs, rules).withColumn("clean", F.when(F.size("found") > 0, hidden).otherwise(text))
    changed = F.size("found") > 0
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length("clean").cast(kind)).otherwise(F.col("row.n_chars"))
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
