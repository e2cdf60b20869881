"""Entity-time panels, entity dimensions, risk sets and treatment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.functions.columns import as_number, clipped, count_where, ratio
from geostrata.operators.ranks import quantiles
from geostrata.operators.skew import hot_key_join, spread_join
from geostrata.session import cut


def previous(value: str, entity: str, time: str) -> Column:
    """Value of the entity's previous row. Panels hold one row per period, so groups are short.

    Rows without an entity have no previous row and are spread.
    """
    loose = F.when(F.col(entity).isNull(), F.xxhash64(time, value))
    return F.when(F.col(entity).isNotNull(), F.lag(value).over(Window.partitionBy(entity, loose).orderBy(time)))


def growth(panel: DataFrame, value: str, entity: str, time: str) -> DataFrame:
    """Change and rate against the previous row; the rate needs a positive base."""
    out = panel.withColumn("_prev", previous(value, entity, time))
    change = F.col(value) - F.col("_prev")
    return out.withColumns({
        "chg": change, "chg_rate": F.when(F.col("_prev") > 0, change / F.col("_prev")),
    }).drop("_prev")


def growth_abs(panel: DataFrame, value: str, entity: str, time: str, clip: float = 0.5) -> DataFrame:
    """(v - prev) / |prev|, null for a zero base, clipped."""
    prev = previous(value, entity, time)
    return panel.withColumn("_prev", prev).withColumn(
        "y", clipped(F.try_divide(F.col(value) - F.col("_prev"), F.nullif(F.abs("_prev"), F.lit(0.0))), -clip, clip)
    ).drop("_prev")


def first_valid(c: str, t: str) -> Column:
    """Earliest non-null value."""
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col(t)))


def last_valid(c: str, t: str) -> Column:
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(t)))


def dim_last_row(panel: DataFrame, entity: str, time: str, first: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    """First non-null of some columns, and the true last row (nulls kept) of others."""
    end = F.max_by(F.struct(F.col(time).alias("_t"), *last), F.col(time))
    out = panel.groupBy(entity).agg(
        F.min(time).alias("first_year"), F.max(time).alias("last_year"),
        *[first_valid(c, time).alias(f"{c}_first") for c in first], end.alias("_end"),
    )
    return out.select(
        entity, "first_year", "last_year", *[f"{c}_first" for c in first],
        *[F.col(f"_end.{c}").alias(f"{c}_last") for c in last],
    )


def dim_last_valid(panel: DataFrame, entity: str, time: str, first: Sequence[str] = (), last: Sequence[str] = (),
                   birth: str | None = None, death: str | None = None) -> DataFrame:
    """First and last non-null values; birth is the earliest, death the latest year seen."""
    extra = []
    if birth:
        extra.append(F.min(birth).alias("est_year"))
    if death:
        extra.append(F.max(death).alias("acq_year"))
    return panel.groupBy(entity).agg(
        F.min(time).alias("first_year"), F.max(time).alias("last_year"), *extra,
        *[first_valid(c, time).alias(f"{c}_first") for c in first],
        *[last_valid(c, time).alias(f"{c}_last") for c in last],
    )


def event_type(death: str, last: str, end_year: int | Column) -> Column:
    """closed when a death is known, alive when seen in the final year, else attrition."""
    end = F.lit(end_year) if isinstance(end_year, int) else end_year
    return F.when(F.col(death).isNotNull(), "closed").when(F.col(last) >= end, "alive").otherwise("attrition")


def survival_fields(dim: DataFrame, panel_start: int, missing_birth_truncated: bool = True) -> DataFrame:
    """Observation end, duration, censoring, truncation and age of each entity."""
    end = F.coalesce("acq_year", "last_year")
    return dim.withColumns({
        "obs_end": end,
        "duration": F.greatest(F.lit(1), end - F.col("first_year") + 1),
        "right_censored": F.when(F.col("acq_year").isNull(), 1).otherwise(0),
        "event": F.when(F.col("acq_year").isNotNull(), "closed").otherwise("alive"),
        "left_truncated": F.coalesce((F.col("est_year") < panel_start).cast("int"), F.lit(int(missing_birth_truncated))),
        "age": F.col("last_year") - F.coalesce("est_year", "first_year"),
        "alive_years": F.col("last_year") - F.col("first_year") + 1,
    })


def local_density(dim: DataFrame, cell: str, name: str = "neighbor_count") -> DataFrame:
    """Entities per cell including the entity itself; 0 without a cell."""
    placed = dim.filter(F.col(cell).isNotNull())
    counts = placed.groupBy(cell).agg(F.count("*").alias(name))
    rest = dim.filter(F.col(cell).isNull()).withColumn(name, F.lit(0).cast("long"))
    return hot_key_join(placed, counts, [cell], name).unionByName(rest)


def group_fragility(dim: DataFrame, group: str, closed: Column, lat: str = "lat", lng: str = "lng",
                    total: str | None = None) -> DataFrame:
    """Size, closures and geographic spread per group; tier by the median spread of larger groups."""
    aggs = [F.count("*").alias("n_branches"), count_where(closed).alias("n_closed"),
            F.stddev_samp(lat).alias("lat_std"), F.stddev_samp(lng).alias("lng_std")]
    if total:
        aggs.append(F.sum(total).alias("total"))
    g = dim.filter(F.col(group).isNotNull()).groupBy(group).agg(*aggs).withColumn(
        # rounded, so that the group that is the median never falls on either side of it by chance
        "geo_spread", F.round(F.sqrt(F.col("lat_std") * F.col("lat_std") + F.col("lng_std") * F.col("lng_std")), 9)
    )
    median = quantiles(g.filter("n_branches > 1"), {"geo_spread": (0.5,)})["geo_spread", 0.5]
    tier = (
        F.when(F.col("n_branches") == 1, "single")
        .when(F.col("geo_spread") < F.lit(median).cast("double"), "concentrated").otherwise("dispersed")
    )
    return g.withColumns({"tier": tier, "closed_rate": F.round(F.col("n_closed") / F.col("n_branches"), 6)})


def closed_rate_as_of(risk: DataFrame, group: str, year: str, event: str) -> DataFrame:
    """Closure rate of each group from earlier years only, so no row sees its own future."""
    per_year = risk.groupBy(group, year).agg(F.sum(event).alias("_d"), F.count("*").alias("_n"))
    w = Window.partitionBy(group).orderBy(year).rowsBetween(Window.unboundedPreceding, -1)
    rate = F.coalesce(ratio(F.sum("_d").over(w), F.sum("_n").over(w)), F.lit(0.0))
    return per_year.select(group, year, rate.alias("closed_rate_before"))


def person_period(dim: DataFrame, entity: str = "entity", keep: Sequence[str] = ()) -> DataFrame:
    """One row per entity and year at risk; entities whose event precedes entry are left out."""
    death, first = F.col("acq_year"), F.col("first_year")
    base = dim.filter(death.isNull() | (death >= first)).withColumns({
        "_end": F.coalesce("acq_year", "last_year"), "_birth": F.coalesce("est_year", "first_year"),
    })
    year = F.explode(F.sequence("first_year", F.greatest("_end", "first_year"))).alias("year")
    rows = base.select(entity, *keep, "acq_year", "_end", "_birth", year)
    event = F.when(F.col("year") == F.col("acq_year"), 1).otherwise(0)
    return rows.select(
        entity, *keep, "year", (F.col("year") - F.col("_birth")).alias("age"), event.alias("event"),
        F.when(F.col("acq_year").isNull() & (F.col("year") == F.col("_end")), 1).otherwise(0).alias("right_censored"),
    )


def assign_treatment(panel: DataFrame, entity: str, time: str, treat_year: str | None = None,
                     mark: str | None = None, event_date: str | None = None, strength: str | None = None) -> DataFrame:
    """First treatment time per entity from a year, a 0/1 mark or a date; then post and strength.

    Rows without an entity are kept, untreated.
    """
    if treat_year:
        when = as_number(treat_year)
    elif mark:
        when = F.when(F.coalesce(as_number(mark), F.lit(0.0)) > 0, F.col(time).cast("double"))
    elif event_date:
        when = F.year(F.try_to_timestamp(F.col(event_date).cast("string"))).cast("double")
    else:
        raise ValueError("treatment needs a year, a mark or an event date")
    first = cut(panel.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.min(when).alias("first_event_year"), F.count("*").alias("_n")))
    out = hot_key_join(panel.drop("first_event_year"), first, [entity], "_n", "left").drop("_n")
    treated = F.col("first_event_year").isNotNull() & (F.col("first_event_year") > 0)
    out = out.withColumn("treated", F.when(treated, 1).otherwise(0)).withColumn(
        "post", F.when(treated & (F.col(time) >= F.col("first_event_year")), 1).otherwise(0)
    )
    if strength:
        mean = out.filter("post = 1").groupBy(entity).agg(F.avg(as_number(strength)).alias("_s"))
        out = spread_join(out, mean, [entity], first, "_n", "left").withColumn("strength_t0", F.coalesce("_s", F.lit(0.0))).drop("_s")
    else:
        out = out.withColumn("strength_t0", F.col("treated").cast("double"))
    return out.withColumn("post_x_strength", F.col("post") * F.col("strength_t0"))


def strength_support(panel: DataFrame, entity: str, strength: str = "strength_t0",
                     probs: Sequence[float] = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)) -> DataFrame:
    """Where the treated strengths lie: per entity (one value each) and the mean over rows."""
    treated = panel.filter("treated = 1")
    per = treated.groupBy(entity).agg(F.min(strength).alias("s"), F.count("*").alias("n"))
    q = quantiles(per, {"s": probs})
    names = {0.0: "min", 0.5: "median", 1.0: "max"}
    row = per.agg(
        F.count("*").alias("entities"), F.sum("n").alias("rows"), F.avg("s").alias("mean"),
        F.countDistinct("s").alias("distinct_values"),
        ratio(F.sum(F.col("s") * F.col("n")), F.sum("n")).alias("row_mean"),
    )
    return row.withColumns({names.get(p, f"p{int(round(p * 100)):02d}"): F.lit(q["s", p]).cast("double") for p in probs})


def did_panel(panel: DataFrame, treatment: DataFrame, alive: DataFrame, entity: str, time: str) -> DataFrame:
    """Alive entities by year with first event, strength, treated, post and their product."""
    base = panel.join(alive.select(entity), entity, "left_semi").join(treatment, entity, "left")
    first = F.coalesce("first_event_year", F.lit(0)).cast("long")
    out = base.withColumns({"first_event_year": first, "strength_t0": F.coalesce("strength_t0", F.lit(0.0))})
    post = (F.col("first_event_year") > 0) & (F.col(time) >= F.col("first_event_year"))
    return out.withColumns({
        "treated": F.when(F.col("first_event_year") > 0, 1).otherwise(0), "post": F.when(post, 1).otherwise(0),
        "post_x_strength": F.when(post, F.col("strength_t0")).otherwise(F.lit(0.0)),
    })


def event_long(did: DataFrame, time: str, pre: int = 3, post: int = 4) -> DataFrame:
    """Treated rows inside the event window with a strength that fades after the event."""
    tau = F.col(time) - F.col("first_event_year")
    return did.filter("treated = 1").withColumn("tau", tau).filter(F.col("tau").between(-pre, post)).withColumn(
        "strength_decay", F.col("strength_t0") / (1.0 + F.greatest(F.col("tau"), F.lit(0)))
    )


def cell_cross_section(panel: DataFrame, cells: DataFrame, events: DataFrame, entity: str, time: str, value: str,
                       t0: int, t1: int, window: tuple[int, int], k: int = 5, clip: float = 0.5) -> DataFrame:
    """Cells observed in two years: growth, log base, weight, and event cells within ``k`` rings."""
    from geostrata.functions.columns import hex_ring_cells

    rows = panel.filter(F.col(time).isin(t0, t1) & F.col(value).isNotNull()).join(cells.select(entity, "cell"), entity)
    sums = rows.filter(F.col("cell").isNotNull()).groupBy("cell").agg(
        *[F.sum(F.when(F.col(time) == t, F.col(value))).alias(f"v{t}") for t in (t0, t1)],
        F.countDistinct(F.when(F.col(time) == t0, F.col(entity))).alias("n_branches"),
    )
    base = sums.withColumn("growth", F.try_divide(F.col(f"v{t1}"), F.nullif(F.col(f"v{t0}"), F.lit(0.0))) - 1.0).filter("growth is not null")
    hit = events.filter(F.col("acq_year").between(*window) & F.col("cell").isNotNull()).select("cell").distinct()
    # a cell is near an event cell exactly when that cell is near it: spread the (fewer) event cells
    near = (
        hit.select(F.explode(hex_ring_cells("cell", k)).alias("cell"))
        .groupBy("cell").agg(F.count("*").alias("treat_strength"))
    )
    return base.join(near, "cell", "left").withColumns({
        "treat_strength": F.coalesce("treat_strength", F.lit(0)),
        "growth_clip": clipped("growth", -clip, clip), "log_base": F.log1p(f"v{t0}"),
        "weight": F.greatest(F.lit(1.0), F.col("n_branches").cast("double")),
    }).withColumn("treated", F.when(F.col("treat_strength") > 0, 1).otherwise(0))


def bbox_quantile(df: DataFrame, lat: str, lng: str, low: float = 0.01, high: float = 0.99, pad: float = 0.0) -> DataFrame:
    """Mark rows inside the central box of the coordinates."""
    q = quantiles(df, {lat: (low, high), lng: (low, high)})
    inside = F.lit(True)
    for c in (lat, lng):
        inside = inside & F.col(c).between(q[c, low] - pad, q[c, high] + pad)
    return df.withColumn("inside", F.coalesce(inside, F.lit(False)))


def year_spine_counts(df: DataFrame, year: str) -> DataFrame:
    """Events per year without gaps, and their cumulative number (one row per year)."""
    counts = df.filter(F.col(year).isNotNull()).groupBy(F.col(year).alias("year")).agg(F.count("*").alias("n"))
    spine = counts.agg(F.min("year").alias("a"), F.max("year").alias("b")).select(F.explode(F.sequence("a", "b")).alias("year"))
    full = spine.join(counts, "year", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(F.lit(0)).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return full.withColumn("cumulative", F.sum("n").over(w))


def event_epoch_ms(year: str) -> Column:
    """30 June of the year, in UTC milliseconds."""
    days = F.datediff(F.make_date(F.col(year).cast("int"), F.lit(6), F.lit(30)), F.lit("1970-01-01").cast("date"))
    return days.cast("long") * 86_400_000


def parallel_trend(panel: DataFrame, dim: DataFrame, entity: str, time: str, value: str, clip: float = 0.5) -> DataFrame:
    """Mean and median growth of closed entities before exit against alive ones, one row."""
    rates = panel.filter(F.col(value).isNotNull()).withColumn("_prev", previous(value, entity, time)).withColumn(
        "rate", clipped(F.try_divide(F.col(value) - F.col("_prev"), F.nullif(F.col("_prev"), F.lit(0.0))), -clip, clip)
    )
    tagged = rates.join(dim.select(entity, "event_type", "last_year"), entity)
    pre = (F.col("event_type") == "closed") & (F.col(time) <= F.col("last_year") - 1)
    wide = tagged.select(
        F.when(pre, F.col("rate")).alias("t"), F.when(F.col("event_type") == "alive", F.col("rate")).alias("c")
    )
    q = quantiles(wide, {"t": (0.5,), "c": (0.5,)})
    return wide.agg(
        F.avg("t").alias("treated_mean"), F.avg("c").alias("control_mean"), (F.avg("t") - F.avg("c")).alias("gap")
    ).withColumns({"treated_median": F.lit(q["t", 0.5]).cast("double"), "control_median": F.lit(q["c", 0.5]).cast("double")})
