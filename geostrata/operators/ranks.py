"""Exact order statistics and running totals without a one-partition sort.

Two helpers carry every operator that needs a global order:

* ``quantiles`` narrows each order statistic to a small bracket by counting passes, so only a
  bounded number of rows is ever sorted and only the resulting numbers reach the driver.
* ``running_total`` splits the order column at approximate percentiles, adds up whole buckets
  first and then accumulates inside each bucket, so no task holds more than one bucket.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geostrata.session import cut

DIRECT_ROWS = 200_000  # rows that may be sorted in one step
APPROX_ACCURACY = 10_000  # rank error of the bracketing pass is n / accuracy


def _number(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], direct_rows: int = DIRECT_ROWS
) -> dict[tuple[str, float], float | None]:
    """Exact linearly interpolated quantiles of numeric columns, nulls ignored."""
    wanted = {c: list(dict.fromkeys(ps)) for c, ps in wanted.items() if ps}
    if not wanted:
        return {}
    base = df.select(*[_number(c).alias(c) for c in wanted])
    sizes = base.agg(*[F.count(c).alias(c) for c in wanted]).first().asDict()

    out: dict[tuple[str, float], float | None] = {}
    ranks: dict[str, set[int]] = {}
    for c, ps in wanted.items():
        for p in ps:
            if sizes[c] == 0:
                out[c, p] = None
            else:
                pos = p * (sizes[c] - 1)
                ranks.setdefault(c, set()).update((math.floor(pos), math.ceil(pos)))

    found = _order_statistics(base, sizes, ranks, direct_rows)
    for c, ps in wanted.items():
        for p in ps:
            if sizes[c]:
                pos = p * (sizes[c] - 1)
                lo, hi = found[c, math.floor(pos)], found[c, math.ceil(pos)]
                out[c, p] = lo + (hi - lo) * (pos - math.floor(pos))
    return out


def quantile(df: DataFrame, column: str, p: float) -> float | None:
    return quantiles(df, {column: [p]})[column, p]


def _order_statistics(base, sizes, ranks, direct_rows):
    """Values at zero-based ranks, as {(column, rank): value}.

    Neighbouring ranks form one unit (column, first, last). A unit's bracket is a closed value
    interval (lo, hi) with the number of values below and inside it.
    """
    open_ = {}
    for c, ks in ranks.items():
        ordered = sorted(ks)
        i = 0
        while i < len(ordered):
            j = i + 1 if i + 1 < len(ordered) and ordered[i + 1] == ordered[i] + 1 else i
            open_[c, ordered[i], ordered[j]] = (-math.inf, math.inf, 0, sizes[c])
            i = j + 1
    found: dict[tuple[str, int], float] = {}
    ready = {u: b for u, b in open_.items() if b[3] <= direct_rows}
    open_ = {u: b for u, b in open_.items() if u not in ready}
    while open_:
        still = {}
        for u, b in _tighten(base, open_).items():
            if b[0] == b[1]:
                found[u[0], u[1]] = found[u[0], u[2]] = b[0]
            elif b[3] <= direct_rows or b[:2] == open_[u][:2]:
                # small enough, or unchanged because few distinct values are left
                ready[u] = b
            else:
                still[u] = b
        open_ = still
    found.update(_pick(base, ready))
    return found


def _inside(c: str, lo: float, hi: float) -> Column:
    cond = F.col(c).isNotNull()
    if lo != -math.inf:
        cond = cond & (F.col(c) >= lo)
    if hi != math.inf:
        cond = cond & (F.col(c) <= hi)
    return cond


def _tighten(base, open_):
    """One pass proposes new bounds (one sketch per distinct bracket), a second one counts."""
    shared: dict[tuple, list] = {}
    for u, (lo, hi, below, inside) in open_.items():
        shared.setdefault((u[0], lo, hi, below, inside), []).append(u)
    sketches = []
    for i, ((c, lo, hi, below, inside), units) in enumerate(shared.items()):
        pad = 2.0 / APPROX_ACCURACY
        ps = []
        for _, k0, k1 in units:
            span = max(inside - 1, 1)
            ps += [max(0.0, (k0 - below) / span - pad), min(1.0, (k1 - below) / span + pad)]
        value = F.col(c) if (lo, hi) == (-math.inf, math.inf) else F.when(_inside(c, lo, hi), F.col(c))
        sketches.append(F.percentile_approx(value, ps, APPROX_ACCURACY).alias(f"b{i}"))
    row = base.agg(*sketches).first()

    bounds = {}
    for i, units in enumerate(shared.values()):
        for j, u in enumerate(units):
            bounds[u] = (row[f"b{i}"][2 * j], row[f"b{i}"][2 * j + 1])
    counts = []
    for i, ((c, _, _), (lo, hi)) in enumerate(bounds.items()):
        counts.append(F.sum(F.when(F.col(c) < lo, 1).otherwise(0)).alias(f"n{i}"))
        counts.append(F.sum(F.when(_inside(c, lo, hi), 1).otherwise(0)).alias(f"m{i}"))
    got = base.agg(*counts).first()

    out = {}
    for i, (u, (lo, hi)) in enumerate(bounds.items()):
        old_lo, old_hi, old_below, old_inside = open_[u]
        below, inside = got[f"n{i}"], got[f"m{i}"]
        if below <= u[1] and u[2] < below + inside:
            out[u] = (lo, hi, below, inside)
        elif u[2] < below + inside:  # some rank lies under the proposal
            out[u] = (old_lo, hi, old_below, below + inside - old_below)
        else:
            out[u] = (lo, old_hi, below, old_below + old_inside - below)
    return out


def _pick(base, brackets):
    """Sort the (bounded) values inside each bracket and read off the wanted ranks."""
    if not brackets:
        return {}
    groups: dict[tuple, list] = {}
    for u, (lo, hi, below, _) in brackets.items():
        groups.setdefault((u[0], lo, hi, below), []).append(u)
    entries, hits, useful = [], F.lit(False), F.lit(False)
    for i, ((c, lo, hi, below), units) in enumerate(groups.items()):
        entries.append(F.when(_inside(c, lo, hi), F.struct(F.lit(i).alias("g"), F.col(c).alias("v"))))
        useful = useful | _inside(c, lo, hi)
        wanted = F.lit(False)
        for k in sorted({k for _, k0, k1 in units for k in (k0, k1)}):
            wanted = wanted | ((F.col("before") <= k - below) & (F.lit(k - below) < F.col("upto")))
        hits = F.when(F.col("g") == i, wanted).otherwise(hits)
    values = (
        base.filter(useful).select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy(F.col("e.g").alias("g"), F.col("e.v").alias("v"))
        .agg(F.count("*").alias("n"))
    )
    w = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        values.withColumn("upto", F.sum("n").over(w))
        .withColumn("before", F.col("upto") - F.col("n"))
        .filter(hits)
        .collect()
    )
    out = {}
    for i, ((c, _, _, below), units) in enumerate(groups.items()):
        mine = [r for r in rows if r["g"] == i]
        for _, k0, k1 in units:
            for k in (k0, k1):
                out[c, k] = next(r["v"] for r in mine if r["before"] <= k - below < r["upto"])
    return out


# --- distinct values ---------------------------------------------------------------------------


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(field, distinct) for many columns at once.

    Columns of one kind become narrow (field, value) pairs, so every pair is hashed once and the
    partial aggregation shrinks it before the shuffle; a multi-column COUNT(DISTINCT) would send
    rows as wide as the table instead.
    """
    kinds: dict[str, list[str]] = {}
    for f in df.schema.fields:
        if columns is None or f.name in columns:
            if isinstance(f.dataType, T.IntegralType):
                kinds.setdefault("long", []).append(f.name)
            elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                kinds.setdefault("double", []).append(f.name)
            else:
                kinds.setdefault("string", []).append(f.name)
    parts = []
    for kind, names in kinds.items():
        pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast(kind).alias("value")) for c in names])
        seen = df.select(F.inline(pairs)).groupBy("field", "value").agg(F.lit(1).alias("one"))
        parts.append(seen.groupBy("field").agg(F.count("value").alias("distinct")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- running totals ----------------------------------------------------------------------------


def split_points(df: DataFrame, order: str | Column, buckets: int) -> list:
    """At most ``buckets - 1`` values that cut ``order`` into parts of similar size."""
    ps = [i / buckets for i in range(1, buckets)]
    col = F.col(order) if isinstance(order, str) else order
    got = df.agg(F.percentile_approx(col, ps, 100 * buckets).alias("p")).first()["p"] or []
    return sorted(set(got))


def bucket_of(order: str | Column, points: Sequence) -> Column:
    """Index of the part that holds a value: the number of split points at or below it."""
    col = F.col(order) if isinstance(order, str) else order
    if not points:
        return F.lit(0)
    tree = _bisect(col, list(points), 0)
    return tree


def _bisect(col: Column, points: list, base: int) -> Column:
    if not points:
        return F.lit(base)
    mid = len(points) // 2
    return F.when(col < F.lit(points[mid]), _bisect(col, points[:mid], base)).otherwise(
        _bisect(col, points[mid + 1 :], base + mid + 1)
    )


def default_buckets(df: DataFrame) -> int:
    return max(2, min(512, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def running_total(
    df: DataFrame,
    order: str,
    amounts: Mapping[str, str],
    by: Sequence[str] = (),
    descending: bool = False,
    inclusive: bool = True,
    buckets: int | None = None,
) -> DataFrame:
    """Add running sums of ``amounts`` (output name -> input column) along ``order``.

    Rows should already be one per (by, order) value; callers aggregate first, which also removes
    any hot value. ``inclusive=False`` leaves the current row out.
    """
    by = list(by)
    points = split_points(df, F.col(order).cast("double"), buckets or default_buckets(df))
    bucket = bucket_of(F.col(order).cast("double"), points)
    parts = df.withColumn("_part", bucket)

    whole = parts.groupBy(*by, "_part").agg(
        *[F.sum(src).alias(f"_sum_{out}") for out, src in amounts.items()]
    )
    # one row per (group, bucket): the window below sees at most `buckets` rows per group
    seq = F.col("_part").desc() if descending else F.col("_part").asc()
    w0 = Window.partitionBy(*by, F.lit(0)).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    carry = whole.select(
        *by,
        "_part",
        *[
            F.coalesce(F.sum(f"_sum_{out}").over(w0), F.lit(0)).alias(f"_carry_{out}")
            for out in amounts
        ],
    )
    keys = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in [*by, "_part"]]
    joined = parts.alias("_l").join(
        carry.alias("_r"), on=_all(keys), how="inner"
    ).select("_l.*", *[F.col(f"_r._carry_{out}") for out in amounts])

    direction = F.col(order).desc() if descending else F.col(order).asc()
    end = 0 if inclusive else -1
    w = Window.partitionBy(*by, "_part").orderBy(direction).rowsBetween(
        Window.unboundedPreceding, end
    )
    return joined.withColumns(
        {
            out: F.col(f"_carry_{out}") + F.coalesce(F.sum(src).over(w), F.lit(0))
            for out, src in amounts.items()
        }
    ).drop("_part", *[f"_carry_{out}" for out in amounts])


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def carry_fill(
    df: DataFrame, column: str, order: str | Sequence[str], by: Sequence[str] = (), forward: bool = True,
    buckets: int | None = None,
) -> DataFrame:
    """Fill nulls with the previous (or next) value along ``order``, one column or several of any sortable type.

    Rows equal in ``order`` follow a hash of the row, so the result does not hang on task order and a constant order
    column is spread as well. The table is written once in ranges of the order; whole ranges are carried first, then
    each is filled on its own. Null order values come first.
    """
    by, order = list(by), [order] if isinstance(order, str) else list(order)
    tied = df.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    parts = cut(tied.repartitionByRange(max(2, buckets or default_buckets(df)), *by, *order, "_tie").withColumn("_part", F.spark_partition_id()))
    place = F.struct(*order, "_tie")
    edge = (F.max_by if forward else F.min_by)(F.col(column), F.when(F.col(column).isNotNull(), place))
    ends = parts.groupBy(*by, "_part").agg(edge.alias("_end"))
    seq = F.col("_part").asc() if forward else F.col("_part").desc()
    w0 = Window.partitionBy(*by, F.lit(0)).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    carry = ends.select(*by, "_part", F.last("_end", ignorenulls=True).over(w0).alias("_carry"))
    keys = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in [*by, "_part"]]
    joined = parts.alias("_l").join(carry.alias("_r"), on=_all(keys)).select("_l.*", "_r._carry")
    direction = [F.col(c).asc() if forward else F.col(c).desc() for c in [*order, "_tie"]]
    w = Window.partitionBy(*by, "_part").orderBy(*direction).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last(column, ignorenulls=True).over(w), F.col("_carry"))
    return joined.withColumn(column, filled).select(*df.columns)


def group_quantile(df: DataFrame, by: Sequence[str], column: str, p: float, name: str) -> DataFrame:
    """Exact quantile per group; a group of any size is spread over many tasks."""
    by = list(by)
    counts = df.select(*by, _number(column).alias("_v")).filter(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(
        F.count("*").alias("_n")
    )
    ranked = running_total(counts, "_v", {"_upto": "_n"}, by=by)
    totals = counts.groupBy(*by).agg(((F.sum("_n") - 1) * F.lit(float(p))).alias("_pos"))
    keys = _all([F.col(f"_a.{k}").eqNullSafe(F.col(f"_b.{k}")) for k in by])
    both = ranked.alias("_a").join(totals.alias("_b"), keys).select("_a.*", "_b._pos")
    at = lambda pos: F.min(F.when(F.col("_upto") > pos, F.col("_v")))
    lo, hi = at(F.floor("_pos")), at(F.ceil("_pos"))
    return both.groupBy(*by).agg((lo + (hi - lo) * (F.max("_pos") - F.floor(F.max("_pos")))).alias(name))
