"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geostrata.session import cut

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_DEFAULT, BATCH_BYTES = "67108864b", 4_194_304

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers of a local session started from any folder.

    On a cluster the package comes with the job (``--py-files`` or an installed package).
    """
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local[") or app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="geostrata-"), "geostrata-package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "geostrata")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)


def mapped(rows: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` in batches of about ``BATCH_BYTES``, a longer row alone.

    Spark's own limit of 64 MB lets a batch hold a task's whole input, once in the executor and again in its Python
    worker. The limit is a setting of the session, read when the job runs; one that the user has chosen stays.
    """
    conf = rows.sparkSession.conf
    if conf.get(BATCH_CONF, None) == BATCH_DEFAULT:
        conf.set(BATCH_CONF, f"{BATCH_BYTES}b")
    return rows.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null read as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """The whole row in the struct ``row`` beside new columns, so that no name can clash with the input's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def components(links: DataFrame) -> DataFrame:
    """Connected components of undirected ``links (a, b)``: ``(node, label)``, label = smallest node reachable.

    Every round takes the smallest label among a node's neighbours and then that label's own label, so path
    lengths halve; each round is written to the shared folder. Rows per round: the links and the nodes.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("around"))
        )
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "around").alias("next"))
        above = labels.select(F.col("node").alias("next"), F.col("label").alias("over"))
        step = cut(hooked.join(above, "next").select("node", "old", F.least("next", "over").alias("label")))
        moved = step.where("label <> old").limit(1).count()
        labels = step.select("node", "label")
        if not moved:
            return labels
