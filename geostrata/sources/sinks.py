"""Writers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.functions.columns import nan_to_null
from geostrata.sources.formats import UnsupportedFormat


def write(df: DataFrame, path: str, fmt: str, partition_by: Sequence[str] = (), mode: str = "errorifexists", bom: bool = False) -> None:
    """Write a table as ``csv``, ``tsv``, ``jsonl`` (one object per line), ``json`` (an array per file) or ``parquet``.

    ``bom`` puts a byte-order mark before the header of delimited text, for spreadsheets. A null stays a null in JSON.
    """
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt in ("csv", "tsv"):
        sep = "\t" if fmt == "tsv" else ","
        if bom:
            if partition_by:
                raise ValueError("a byte-order mark is for files without partitions")
            _framed(_delimited(df, sep), path, mode, "\ufeff" + sep.join(_quoted_name(c, sep) for c in df.columns), None, "")
        else:
            writer.option("header", True).option("escape", '"').csv(path, sep=sep)
    elif fmt == "json" and not partition_by:
        rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
        _framed(rows, path, mode, "[", "]", ",")
    elif fmt in ("json", "jsonl", "ndjson"):
        writer.option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise UnsupportedFormat(f"cannot write {fmt}")


def _quoted_name(name: str, sep: str) -> str:
    return '"' + name.replace('"', '""') + '"' if any(x in name for x in (sep, '"', "\n", "\r")) else name


def _delimited(df: DataFrame, sep: str) -> DataFrame:
    cells = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.to_csv(cells, {"sep": sep, "escape": '"', "quote": '"'}).alias("value"))


def _framed(rows: DataFrame, path: str, mode: str, first: str, last: str | None, between: str) -> None:
    """Write lines as text, each file with a first (and a last) line and ``between`` behind all rows but its last.

    One file per task; lines pass one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, [first]
        for batch in batches:
            for line in batch.column(0).to_pylist():
                if held is not None:
                    out.append(held + between)
                held = line
            if out:
                yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
                out = []
        out += [x for x in (held, last) if x is not None]
        if out:
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})

    rows.mapInArrow(run, "value string").write.mode(mode).text(path)


def write_bucketed(df: DataFrame, name: str, path: str, entity: str, order: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """Store a table in buckets by entity, sorted inside, and return it: windows and joins by entity need no shuffle.

    ``name`` is the table's in the session's catalog, ``path`` its folder. Rows are dealt by entity first, so each
    bucket is one file. Rows without an entity are one bucket's.
    """
    dealt = df.repartition(buckets, entity)
    dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, entity).sortBy(entity, *order).saveAsTable(name)
    return df.sparkSession.table(name)


def write_report(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """Report tables as JSON below ``folder``; NaN becomes null."""
    for name, df in tables.items():
        write(nan_to_null(df), f"{folder}/{name}", "json", mode=mode)
