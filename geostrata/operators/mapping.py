"""Mapping schemes: ordered column-shaping operations with a report and lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.functions.columns import hex_cell, square_cell
from geostrata.operators.ranks import group_quantile

OPS = ("rename", "derive", "bin", "onehot", "code", "aggregate", "geocode", "drop")
MAX_LEVELS = 1000


@dataclass(frozen=True)
class MapOp:
    op: str
    params: dict[str, Any] = field(default_factory=dict)
    reason: str = ""


@dataclass
class MapResult:
    data: DataFrame
    report: DataFrame
    lineage: DataFrame


def bin_label(a: float, b: float) -> str:
    return f"({a:g}, {b:g}]"


def binned(name: str, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Right-closed bins; the lowest edge and everything outside give null."""
    texts = list(labels) if labels else [bin_label(a, b) for a, b in zip(edges[:-1], edges[1:])]
    if len(texts) != len(edges) - 1:
        raise ValueError("one label per bin is needed")
    out = F.lit(None).cast("string")
    for a, b, t in zip(edges[:-1], edges[1:], texts):
        out = F.when((F.col(name) > a) & (F.col(name) <= b), F.lit(t)).otherwise(out)
    return out


def onehot(df: DataFrame, columns: Sequence[str], max_levels: int = MAX_LEVELS) -> DataFrame:
    """One boolean per sorted distinct value; the source columns go away."""
    new = []
    for c in columns:
        levels = [r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().limit(max_levels + 1).collect()]
        if len(levels) > max_levels:
            raise ValueError(f"{c} has more than {max_levels} distinct values")
        new += [F.coalesce(F.col(c) == F.lit(v), F.lit(False)).alias(f"{c}_{v}") for v in sorted(levels)]
    return df.select(*[c for c in df.columns if c not in columns], *new)


def coded(name: str, mapping: Mapping[Any, Any], default: Any = None) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(name)), F.lit(default))


AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "nunique": F.countDistinct, "std": F.stddev_samp,
}


def aggregate(df: DataFrame, group_by: Sequence[str], agg: Mapping[str, str], order_by: Sequence[str] = ()) -> DataFrame:
    """Grouped aggregates under the source names; null keys are left out.

    ``first`` and ``last`` take non-null values and need ``order_by``.
    """
    keep = df.na.drop(subset=list(group_by))
    plain, medians = [], []
    for c, f in agg.items():
        if f == "median":
            medians.append(c)
        elif f in ("first", "last"):
            if not order_by:
                raise ValueError(f"{f} needs order_by")
            pick = F.min_by if f == "first" else F.max_by
            plain.append(pick(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order_by))).alias(c))
        else:
            plain.append(AGGREGATES[f](c).alias(c))
    groups = keep.groupBy(*group_by)
    out = groups.agg(*plain) if plain else keep.select(*group_by).distinct()
    for c in medians:
        out = out.join(group_quantile(keep, group_by, c, 0.5, c), list(group_by), "left")
    return out.select(*group_by, *agg)


class MappingScheme:
    def __init__(self, ops: Iterable[MapOp] = ()):
        self.ops = list(ops)

    def _add(self, op, reason="", **params) -> MappingScheme:
        self.ops.append(MapOp(op, params, reason))
        return self

    def rename(self, mapping, reason=""):
        return self._add("rename", reason, mapping=dict(mapping))

    def derive(self, name: str, expr: str | Callable[[DataFrame], Column], reason=""):
        return self._add("derive", reason, name=name, expr=expr)

    def bin(self, name, bins, labels=None, reason=""):
        return self._add("bin", reason, field=name, bins=list(bins), labels=labels)

    def onehot(self, columns, reason=""):
        return self._add("onehot", reason, columns=list(columns))

    def code(self, name, mapping, default=None, reason=""):
        return self._add("code", reason, field=name, mapping=dict(mapping), default=default)

    def aggregate(self, group_by, agg, order_by=(), reason=""):
        return self._add("aggregate", reason, group_by=list(group_by), agg=dict(agg), order_by=list(order_by))

    def geocode(self, lat, lng, resolution: int | None = 8, size: float = 0.01, reason=""):
        """Add ``cell``: a hexagon id, or a square-grid id when ``resolution`` is None."""
        return self._add("geocode", reason, lat=lat, lng=lng, resolution=resolution, size=size)

    def drop(self, columns, reason=""):
        return self._add("drop", reason, columns=list(columns))

    @classmethod
    def from_spec(cls, spec: Iterable[Mapping[str, Any]]) -> MappingScheme:
        scheme = cls()
        for item in spec:
            rest = {k: v for k, v in item.items() if k not in ("op", "reason")}
            if item["op"] not in OPS:
                raise ValueError(f"unknown mapping op: {item['op']}")
            if item["op"] in ("bin", "code") and "field" in rest:
                rest["name"] = rest.pop("field")
            getattr(scheme, item["op"])(reason=item.get("reason", ""), **rest)
        return scheme


def apply_scheme(df: DataFrame, scheme: MappingScheme) -> MapResult:
    """Fold the operations over the table; report and lineage come from the scheme itself."""
    report, lineage = [], []

    def line(output, sources, expr, op):
        lineage.append((output, ",".join(sources), expr, op))

    for step, o in enumerate(scheme.ops, start=1):
        p = o.params
        if o.op == "rename":
            df, note = df.withColumnsRenamed(p["mapping"]), str(p["mapping"])
            for a, b in p["mapping"].items():
                line(b, [a], a, o.op)
        elif o.op == "derive":
            made = p["expr"](df) if callable(p["expr"]) else F.expr(p["expr"])
            text = "function" if callable(p["expr"]) else p["expr"]
            df, note = df.withColumn(p["name"], made), p["name"]
            line(p["name"], [c for c in df.columns if c in text and c != p["name"]], text, o.op)
        elif o.op == "bin":
            name = p["field"]
            df, note = df.withColumn(f"{name}_bin", binned(name, p["bins"], p["labels"])), f"{name}_bin"
            line(note, [name], str(p["bins"]), o.op)
        elif o.op == "onehot":
            before = set(df.columns)
            df, note = onehot(df, p["columns"]), ",".join(p["columns"])
            for c in df.columns:
                if c not in before:
                    line(c, p["columns"], "equals level", o.op)
        elif o.op == "code":
            name = p["field"]
            df, note = df.withColumn(f"{name}_code", coded(name, p["mapping"], p["default"])), f"{name}_code"
            line(note, [name], "lookup", o.op)
        elif o.op == "aggregate":
            df, note = aggregate(df, p["group_by"], p["agg"], p["order_by"]), ",".join(p["group_by"])
            for c, f in p["agg"].items():
                line(c, [c], f, o.op)
        elif o.op == "geocode":
            made = square_cell(p["lat"], p["lng"], p["size"]) if p["resolution"] is None else hex_cell(p["lat"], p["lng"], p["resolution"])
            df, note = df.withColumn("cell", made), "cell"
            line("cell", [p["lat"], p["lng"]], "grid cell", o.op)
        elif o.op == "drop":
            df, note = df.drop(*p["columns"]), ",".join(p["columns"])
        else:
            raise ValueError(f"unknown mapping op: {o.op}")
        report.append((step, o.op, note, o.reason))
    spark = df.sparkSession
    return MapResult(
        df, spark.createDataFrame(report, "step int, op string, detail string, reason string"),
        spark.createDataFrame(lineage, "output string, sources string, expression string, op string"),
    )
