"""Ring exposure, event treatment strength and hot-spot spillover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostrata.functions.columns import ratio
from geostrata.operators.distance import ring_counts

FINE = [(0.0, 1.0), (1.0, 3.0), (3.0, 5.0), (5.0, 10.0)]
COARSE = [(0.0, 2.0), (2.0, 5.0), (5.0, 10.0)]
# (from km, to km, weight)
WEIGHTED = [(0.0, 1.0, 1.0), (1.0, 3.0, 0.6), (3.0, 5.0, 0.3), (5.0, 10.0, 0.1)]
COARSE_REBINNED = [(0.0, 2.0, 1.0), (2.0, 5.0, 0.6), (5.0, 10.0, 0.3)]
COARSE_LINEAR = [(0.0, 2.0, 1.0), (2.0, 5.0, 0.6), (5.0, 10.0, 0.2)]


def ring_name(a: float, b: float, prefix: str = "same_ind_ring") -> str:
    return f"{prefix}_{a:g}_{b:g}km".replace(".", "p")


def _edges(rings) -> list[float]:
    return sorted({e for r in rings for e in r[:2]})


def _parts(edges, a, b, prefix="ring_"):
    """Columns of the elementary rings that make up ``[a, b)``."""
    return [f"{prefix}{j}" for j, (x, y) in enumerate(zip(edges[:-1], edges[1:])) if a <= x and y <= b]


def _total(cols: Sequence[str]):
    out = F.lit(0).cast("long")
    for c in cols:
        out = out + F.coalesce(F.col(c), F.lit(0))
    return out


def ring_exposure(
    dim: DataFrame, entity: str = "entity", group: str = "class", event: str = "acq_year",
    rings: Sequence = tuple(FINE + COARSE), keep: Sequence[str] = (), lat: str = "lat", lng: str = "lng",
) -> DataFrame:
    """Same-class neighbours of every closed entity, counted per ``[a, b)`` ring.

    Events without neighbours stay with zeroes; an entity never counts itself.
    """
    edges = _edges(rings)
    located = dim.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull()).withColumn(
        "_grp", F.coalesce(F.col(group).cast("string"), F.lit("NA"))
    )
    events = located.filter(F.col(event).isNotNull())
    counts = ring_counts(events, located, edges, [entity], match=["_grp"], lat=lat, lng=lng)
    self_first = counts.withColumn("ring_0", F.col("ring_0") - 1)  # the entity itself, at 0 km
    out = events.select(entity, *keep).join(self_first, entity, "left")
    names = {ring_name(a, b): _total(_parts(edges, a, b)) for a, b in rings}
    return out.select(
        entity, *keep, _total(_parts(edges, edges[0], edges[-1])).alias(f"n_same_ind_{edges[-1]:g}km"),
        *[v.alias(n) for n, v in names.items()],
    )


def ring_density(exposure: DataFrame, rings=tuple(FINE)) -> DataFrame:
    """Mean count per ring and the same per square km of ring area."""
    import math

    row = exposure.agg(*[F.avg(ring_name(a, b)).alias(ring_name(a, b)) for a, b in rings])
    lines = F.array(
        *[
            F.struct(
                F.lit(f"{a:g}-{b:g}").alias("ring"),
                F.col(ring_name(a, b)).alias("mean_count"),
                (F.col(ring_name(a, b)) / (math.pi * (b * b - a * a))).alias("per_km2"),
            )
            for a, b in rings
        ]
    )
    return row.select(F.inline(lines))


def event_counts(
    entities: DataFrame, events: DataFrame, edges: Sequence[float] = (0, 1, 3, 5, 10),
    entity: str = "entity", group: str = "class", year: str = "event_year", first_year: str = "first_year",
    closed: str = "left",
) -> DataFrame:
    """Events near each entity by event year and ring: same class, entity already observed.

    One row per (entity, event year); the pairs themselves are never listed.
    """
    near = ring_counts(
        entities.select(entity, group, first_year, "lat", "lng"),
        events.select(group, year, "lat", "lng"),
        list(edges), [entity, first_year], match=[group], split=[year], closed=closed,
    )
    return near.filter(F.col(first_year) <= F.col(year)).drop(first_year)


def first_exposure(
    counts: DataFrame, rings=tuple(WEIGHTED), edges: Sequence[float] = (0, 1, 3, 5, 10),
    entity: str = "entity", year: str = "event_year", strength: str = "strength_t0",
) -> DataFrame:
    """First event year of each entity and the ring-weighted number of events in that year."""
    weight = F.lit(0.0)
    for a, b, w in rings:
        weight = weight + F.lit(float(w)) * _total(_parts(list(edges), a, b))
    by_year = counts.select(entity, year, weight.alias("_w"))
    return by_year.groupBy(entity).agg(
        F.min(year).alias("first_event_year"), F.min_by("_w", year).alias(strength)
    )


def ring_spillover(
    cells: DataFrame, rings: Sequence[tuple[float, float]] = ((0, 1), (1, 3), (3, 5), (5, 10)),
    top_n: int = 100, cell: str = "cell", value: str = "value", lat: str = "lat", lng: str = "lng",
) -> DataFrame:
    """Sum, cell count and density by ring around the ``top_n`` cells with the largest value.

    The centres are a report-sized set (``top_n`` rows), so broadcasting them is bounded; every
    cell row is read once and only ring totals are shuffled.
    """
    from geostrata.functions.columns import haversine_km, in_ring

    top = cells.orderBy(F.col(value).desc(), F.col(cell)).limit(top_n)
    centres = top.select(
        F.col(cell).alias("center_cell"), F.col(value).alias("center_value"),
        F.col(lat).alias("_clat"), F.col(lng).alias("_clng"),
    ).collect()
    if not centres:
        raise ValueError("no cells to use as centres")
    outer = max(b for _, b in rings)
    spread = outer / 111.0 * 1.01
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in r.asDict().items()]) for r in centres])
    near_lat = F.filter(listed, lambda e: F.abs(e["_clat"] - F.col(lat)) <= spread)
    d = haversine_km("_clat", "_clng", lat, lng)
    pairs = cells.select(value, lat, lng, F.inline(near_lat)).withColumn("_d", d).filter(F.col("_d") < outer)
    aggs = []
    for a, b in rings:
        tag = ring_name(a, b, "").lstrip("_")
        inside = in_ring(F.col("_d"), a, b)
        total, count = F.sum(F.when(inside, F.col(value))), F.sum(F.when(inside, 1).otherwise(0)).cast("long")
        aggs += [
            F.coalesce(total, F.lit(0.0)).alias(f"spill_{tag}"),
            count.alias(f"cells_{tag}"),
            ratio(total, count).alias(f"spillden_{tag}"),
        ]
    return pairs.groupBy("center_cell", "center_value").agg(*aggs)


def decay_flag(ring_means: DataFrame, order: str = "ring", value: str = "mean_value") -> DataFrame:
    """Is the mean non-increasing from ring to ring? (one row per ring, a handful of rows)"""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    step = F.col(value) <= F.lag(value).over(w)
    return ring_means.select(step.alias("_ok")).agg(F.bool_and(F.coalesce("_ok", F.lit(True))).alias("decaying"))
