"""Spatial weights as an edge table ``(src, dst, w)`` beside a node table; never a matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.functions.columns import hex_ring_cells
from geostrata.operators.distance import knn_edges
from geostrata.operators.skew import spread_join


def contiguity_edges(cells: DataFrame, cell: str = "cell") -> DataFrame:
    """Pairs of touching hexagons that both occur in ``cells`` (one row per cell)."""
    around = cells.select(
        F.col(cell).alias("src"), F.explode(hex_ring_cells(cell, 1, include_center=False)).alias("dst")
    )
    return around.join(cells.select(F.col(cell).alias("dst")), "dst", "left_semi").select("src", "dst")


def row_standardised(edges: DataFrame) -> DataFrame:
    """Give every edge the weight 1 / (neighbours of its source)."""
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    return edges.join(degree, "src").select("src", "dst", (F.lit(1.0) / F.col("degree")).alias("w"))


def knn_weights(points: DataFrame, k: int, node: str = "id", lat: str = "lat", lng: str = "lng",
                metric: str = "plane") -> DataFrame:
    return row_standardised(knn_edges(points, k, node, lat, lng, metric).select("src", "dst"))


def weights_summary(nodes: DataFrame, weights: DataFrame, node: str = "id") -> DataFrame:
    """Nodes, mean neighbours, islands and rows whose weights do not add up to one."""
    rows = weights.groupBy("src").agg(F.count("*").alias("degree"), F.sum("w").alias("total"))
    full = nodes.select(F.col(node).alias("src")).join(rows, "src", "left")
    degree = F.coalesce("degree", F.lit(0))
    return full.agg(
        F.count("*").alias("n"),
        F.avg(degree).alias("mean_neighbors"),
        F.sum(F.when(F.col("degree").isNull(), 1).otherwise(0)).cast("long").alias("islands"),
        F.sum(F.when(F.abs(F.col("total") - 1) > 1e-8, 1).otherwise(0)).cast("long").alias("bad_rows"),
    )


def spatial_lag(nodes: DataFrame, weights: DataFrame, values: dict[str, str], node: str = "id") -> DataFrame:
    """Add the weighted mean over neighbours; ``values`` maps output name to value column.

    Islands keep their row with lag 0. The edge side may point at one node very often (stacked
    points share few neighbours), so that join is split by frequency.
    """
    named = nodes.select(F.col(node).alias("dst"), *[F.col(v).alias(f"_v_{o}") for o, v in values.items()])
    indegree = weights.groupBy("dst").agg(F.count("*").alias("_n"))
    sums = (
        spread_join(weights, named, ["dst"], indegree, "_n")
        .groupBy(F.col("src").alias(node))
        .agg(*[F.sum(F.col("w") * F.col(f"_v_{o}")).alias(o) for o in values])
    )
    joined = nodes.join(sums, node, "left")
    return joined.withColumns({o: F.coalesce(F.col(o), F.lit(0.0)) for o in values})


def weight_moments(weights: DataFrame) -> DataFrame:
    """S0, S1 and S2 of a weight table, one row."""
    pairs = (
        weights.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "w")
        .groupBy("a", "b").agg(F.sum("w").alias("both"))
    )
    s1 = pairs.agg(F.sum(F.col("both") * F.col("both")).alias("s1"))
    rows = weights.select(F.col("src").alias("id"), "w").unionByName(
        weights.select(F.col("dst").alias("id"), "w")
    )
    s2 = rows.groupBy("id").agg(F.sum("w").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("s2"))
    s0 = weights.agg(F.sum("w").alias("s0"))
    return _side_by_side(s0, s1, s2)


def _side_by_side(*one_row: DataFrame) -> DataFrame:
    """Single-row aggregates next to each other (one row each by construction)."""
    out = one_row[0].withColumn("_one", F.lit(1))
    for df in one_row[1:]:
        out = out.join(df.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")
