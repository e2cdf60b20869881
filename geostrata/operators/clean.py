"""Cleaning plans with an audit log.

Actions that only change values mark the rows they touch; every log entry up to the next
row-dropping action is then counted by one aggregation. Nothing runs until the cleaned table or
the log is used, except for the few numbers (mean, quantile, mode) that a fill needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.functions.columns import clipped, count_where
from geostrata.operators.ranks import carry_fill, quantile, quantiles

REVERSIBLE = {"fill": True, "clip": True, "replace": True, "astype": True, "winsorize": True,
              "drop_na": False, "drop_duplicates": False, "drop_columns": False, "filter": False}


@dataclass(frozen=True)
class Action:
    op: str
    fields: tuple[str, ...] = ()
    reason: str = ""
    params: dict[str, Any] = field(default_factory=dict)

    @property
    def label(self) -> str:
        if self.op == "clip" and self.params.get("on_violation") == "to_null":
            return "clip_to_null"
        return self.op


@dataclass
class CleanResult:
    data: DataFrame
    log: DataFrame
    stats: DataFrame


class CleanPlan:
    """An ordered list of atomic actions."""

    def __init__(self, actions: Iterable[Action] = ()):
        self.actions = list(actions)

    def _add(self, op, fields=(), reason="", **params) -> CleanPlan:
        self.actions.append(Action(op, tuple(fields), reason, params))
        return self

    def drop_na(self, subset: Iterable[str] = (), reason: str = "") -> CleanPlan:
        return self._add("drop_na", subset, reason)

    def fill(self, name: str, method: str = "constant", value: Any = None, reason: str = "",
             order_by: str | Sequence[str] | None = None, partition_by: Sequence[str] = ()) -> CleanPlan:
        return self._add("fill", [name], reason, method=method, value=value, order_by=order_by,
                         partition_by=tuple(partition_by))

    def clip(self, name: str, lower=None, upper=None, reason: str = "", on_violation: str = "clip") -> CleanPlan:
        return self._add("clip", [name], reason, lower=lower, upper=upper, on_violation=on_violation)

    def replace(self, name: str, to_replace: Any, value: Any, reason: str = "") -> CleanPlan:
        return self._add("replace", [name], reason, to_replace=to_replace, value=value)

    def drop_duplicates(self, subset: Iterable[str] | None = None, keep: str = "first", reason: str = "") -> CleanPlan:
        return self._add("drop_duplicates", subset or (), reason, keep=keep)

    def astype(self, name: str, dtype: str, reason: str = "") -> CleanPlan:
        return self._add("astype", [name], reason, dtype=dtype)

    def winsorize(self, name: str, quantile: float = 0.01, reason: str = "") -> CleanPlan:
        return self._add("winsorize", [name], reason, quantile=quantile)

    def drop_columns(self, columns: Iterable[str], reason: str = "") -> CleanPlan:
        return self._add("drop_columns", columns, reason)

    def filter(self, predicate: Callable[[DataFrame], Column] | Column | str, reason: str = "") -> CleanPlan:
        return self._add("filter", (), reason, predicate=predicate)

    @classmethod
    def from_spec(cls, spec: Iterable[Mapping[str, Any]]) -> CleanPlan:
        """A plan from configuration; a filter is code and cannot be configured."""
        plan = cls()
        for item in spec:
            op = item["op"]
            if op not in REVERSIBLE or op == "filter":
                raise ValueError(f"unknown clean op: {op}")
            names = item.get("subset") if op == "drop_duplicates" else item.get("field")
            names = [names] if isinstance(names, str) else list(names or ())
            rest = {k: v for k, v in item.items() if k not in ("op", "field", "subset", "reason")}
            if op == "fill":
                rest.setdefault("method", "constant")
            if op == "clip":
                rest.setdefault("on_violation", "clip")
            if op == "drop_duplicates":
                rest.setdefault("keep", "first")
            if op == "winsorize":
                rest.setdefault("quantile", 0.01)
            if op == "astype" and "dtype" not in rest or op == "replace" and "to_replace" not in rest:
                raise ValueError(f"incomplete clean op: {dict(item)}")
            plan._add(op, names, item.get("reason", ""), **rest)
        return plan


# --- single steps ------------------------------------------------------------------------------


def drop_na(df: DataFrame, subset: Sequence[str] = ()) -> DataFrame:
    return df.na.drop(subset=list(subset) or None)


def fill_value(df: DataFrame, name: str, method: str, value: Any = None) -> Any:
    """The constant that a fill puts in place of nulls."""
    if method == "constant":
        return value
    if method == "mean":
        return df.agg(F.avg(name)).first()[0]
    if method == "median":
        return quantile(df, name, 0.5)
    if method == "mode":
        counts = df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
        top = counts.orderBy(F.col("n").desc(), name).limit(1).collect()
        return top[0][name] if top else None
    raise ValueError(f"unknown fill method: {method}")


def fill(df: DataFrame, name: str, method: str = "constant", value: Any = None,
         order_by: str | Sequence[str] | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Fill nulls; ``ffill``/``bfill`` need the columns that define the row order."""
    if method in ("ffill", "bfill"):
        if not order_by:
            raise ValueError(f"{method} needs order_by")
        return carry_fill(df, name, order_by, partition_by, method == "ffill")
    put = fill_value(df, name, method, value)
    return df if put is None else df.withColumn(name, F.coalesce(F.col(name), F.lit(put)))


def outside(name: str, lower=None, upper=None) -> Column:
    out = F.lit(False)
    if lower is not None:
        out = out | (F.col(name) < F.lit(lower))
    if upper is not None:
        out = out | (F.col(name) > F.lit(upper))
    return F.coalesce(out, F.lit(False))


def clip(df: DataFrame, name: str, lower=None, upper=None, on_violation: str = "clip") -> DataFrame:
    if on_violation == "to_null":
        return df.withColumn(name, F.when(~outside(name, lower, upper), F.col(name)))
    return df.withColumn(name, clipped(name, lower, upper))


def replace(df: DataFrame, name: str, to_replace: Any, value: Any) -> DataFrame:
    return df.withColumn(name, F.when(F.col(name) == F.lit(to_replace), F.lit(value)).otherwise(F.col(name)))


def deduplicate(df: DataFrame, subset: Sequence[str] | None, order_by: Sequence[str], keep: str = "first") -> DataFrame:
    """First or last row per key by an explicit order; nulls are equal.

    An aggregation that keeps one row per key: partial results shrink before the shuffle, so a key
    that holds most rows is no burden.
    """
    keys = list(subset or df.columns)
    pick = F.min_by if keep == "first" else F.max_by
    row = pick(F.struct(*df.columns), F.struct(*order_by))
    named = {k: f"_k{i}" for i, k in enumerate(keys)}
    return df.groupBy(*[F.col(k).alias(a) for k, a in named.items()]).agg(row.alias("_row")).select("_row.*")


def winsorize(df: DataFrame, name: str, q: float = 0.01) -> DataFrame:
    got = quantiles(df, {name: (q, 1 - q)})
    return df.withColumn(name, clipped(name, got[name, q], got[name, 1 - q]))


def apply_predicate(df: DataFrame, predicate) -> Column:
    cond = predicate(df) if callable(predicate) and not isinstance(predicate, Column) else predicate
    return F.expr(cond) if isinstance(cond, str) else cond


# --- whole plans -------------------------------------------------------------------------------

LOG = ("step", "action", "field", "reason", "affected_rows", "reversible")


def clean(df: DataFrame, plan: CleanPlan, order_by: Sequence[str] = ()) -> CleanResult:
    """Run a plan. ``order_by`` gives the row order for duplicates and carried values."""
    start, logs, pending = df, [], []

    def entry(step, a, names, count):
        return F.struct(
            F.lit(step).cast("long").alias("step"), F.lit(a.label).alias("action"),
            F.lit(",".join(names)).alias("field"), F.lit(a.reason).alias("reason"),
            count.alias("affected_rows"), F.lit(REVERSIBLE[a.op]).alias("reversible"),
        )

    def flush(frame):
        """Count all marks gathered so far in one aggregation and remove them."""
        if pending:
            row = frame.agg(*[count_where(F.col(m)).alias(m) for _, _, _, m in pending])
            logs.append(row.select(F.inline(F.array(*[entry(s, a, n, F.col(m)) for s, a, n, m in pending]))))
            frame = frame.drop(*[m for _, _, _, m in pending])
            pending.clear()
        return frame

    for step, a in enumerate(plan.actions, start=1):
        mark = f"_mark{step}"
        visible = [c for c in df.columns if not c.startswith("_mark")]
        names = a.fields or (tuple(visible) if a.op == "drop_na" else ())
        shown = names if names or a.op != "drop_duplicates" else ("<all>",)
        p = a.params

        def touch(cond, frame):
            pending.append((step, a, shown, mark))
            return frame.withColumn(mark, F.coalesce(cond, F.lit(False)))

        if a.op in ("drop_na", "filter"):
            if a.op == "drop_na":
                gone = F.lit(False)
                for c in names:
                    gone = gone | F.col(c).isNull()
            else:
                gone = ~F.coalesce(apply_predicate(df, p["predicate"]), F.lit(False))
            marked = touch(gone, df)
            keep = marked.filter(~F.col(mark)).drop(*[m for *_, m in pending])
            flush(marked)
            df = keep
        elif a.op == "drop_duplicates":
            order = list(order_by)
            if not order:
                raise ValueError("drop_duplicates needs order_by")
            df = flush(df)
            keys = list(names) or df.columns
            row = df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(
                F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("_gone"))
            logs.append(row.select(F.inline(F.array(entry(step, a, shown, F.col("_gone"))))))
            df = deduplicate(df, names or None, order, p.get("keep", "first"))
        elif a.op == "drop_columns":
            df = touch(F.lit(True), df).drop(*names)
        else:
            name = names[0]
            if a.op == "fill":
                df = touch(F.col(name).isNull(), df)
                order = p.get("order_by") or list(order_by)
                df = fill(df, name, p.get("method", "constant"), p.get("value"), order, p.get("partition_by") or ())
            elif a.op == "clip":
                df = touch(outside(name, p.get("lower"), p.get("upper")), df)
                df = clip(df, name, p.get("lower"), p.get("upper"), p.get("on_violation", "clip"))
            elif a.op == "replace":
                df = replace(touch(F.col(name) == F.lit(p["to_replace"]), df), name, p["to_replace"], p.get("value"))
            elif a.op == "astype":
                df = touch(F.lit(True), df).withColumn(name, F.col(name).cast(p["dtype"]))
            elif a.op == "winsorize":
                q = p.get("quantile", 0.01)
                got = quantiles(df, {name: (q, 1 - q)})
                df = touch(outside(name, got[name, q], got[name, 1 - q]), df)
                df = df.withColumn(name, clipped(name, got[name, q], got[name, 1 - q]))
            else:
                raise ValueError(f"unknown clean op: {a.op}")
    df = flush(df)
    log = logs[0] if logs else start.sparkSession.createDataFrame(
        [], "step long, action string, field string, reason string, affected_rows long, reversible boolean")
    for more in logs[1:]:
        log = log.unionByName(more)
    before = start.agg(F.count("*").alias("before_rows")).withColumn("_one", F.lit(1))
    after = df.agg(F.count("*").alias("after_rows")).withColumn("_one", F.lit(1))
    stats = before.join(after, "_one").drop("_one").withColumn("removed_rows", F.col("before_rows") - F.col("after_rows"))
    return CleanResult(df, log, stats)


def impact_by_action(log: DataFrame) -> DataFrame:
    return log.groupBy("action").agg(F.count("*").alias("steps"), F.sum("affected_rows").alias("affected_rows"))


IMPACT = {"fill": "filled", "clip_to_null": "nulled", "clip": "clipped", "replace": "replaced",
          "winsorize": "winsorized", "drop_na": "dropped_rows"}


def impact_by_field(log: DataFrame) -> DataFrame:
    """Touched rows per field and kind of action (the log has one row per step)."""
    each = log.withColumn("field", F.explode(F.split("field", ",")))
    return each.groupBy("field").agg(*[
        F.coalesce(F.sum(F.when(F.col("action") == a, F.col("affected_rows"))), F.lit(0)).alias(n)
        for a, n in IMPACT.items()
    ])


def forbidden_hits(log: DataFrame, forbidden: Iterable[tuple[str, str]]) -> DataFrame:
    """Log entries that did something the configuration forbids (exact field names)."""
    rules = log.sparkSession.createDataFrame(list(forbidden), "action string, field string")
    each = log.withColumn("field", F.explode(F.split("field", ",")))
    return each.join(F.broadcast(rules), ["action", "field"]).select("step", "action", "field", "affected_rows")
