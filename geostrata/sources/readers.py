"""Readers for delimited text, JSON, XML, N-Triples, workbooks and unions of many files."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geostrata.functions.columns import as_number, nan_to_null
from geostrata.operators.infer import SOURCE_FILE
from geostrata.session import cut
from geostrata.sources.discover import expand, first_lines, peek_columns
from geostrata.sources.first_block import first_blocks, reachable
from geostrata.sources.formats import UnsupportedFormat, detect_format

ENCODINGS = ("utf-8", "gb18030", "latin-1")  # tried in this order


def _paths(path: str | Sequence[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def detect_encoding(spark: SparkSession, path: str | Sequence[str]) -> str:
    """First encoding in which every line of the files can be decoded."""
    lines = spark.read.text(_paths(path))
    if lines.agg(F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True))).first()[0]:
        return "utf-8"

    def undecodable(batches: Iterable[pd.DataFrame]):
        for b in batches:
            bad = 0
            for raw in b["raw"]:
                try:
                    bytes(raw).decode("gb18030")
                except UnicodeDecodeError:
                    bad += 1
            yield pd.DataFrame({"bad": [bad]})

    raw = lines.select(F.col("value").cast("binary").alias("raw"))
    bad = raw.mapInPandas(undecodable, "bad long").agg(F.sum("bad")).first()[0]
    return "latin-1" if bad else "gb18030"


def read_csv(spark: SparkSession, path: str | Sequence[str], sep: str | None = None, header: bool = True,
             schema: T.StructType | str | None = None, encoding: str | None = None, infer: bool = True) -> DataFrame:
    """Comma or tab text by extension. The encoding is checked over the whole files."""
    paths = _paths(path)
    sep = sep or ("\t" if detect_format(paths[0]) == "tsv" else ",")
    encoding = encoding or detect_encoding(spark, paths)
    reader = spark.read.option("header", header).option("sep", sep).option("quote", '"').option("escape", '"')
    if encoding != "utf-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # the two other encodings need it
        reader = reader.option("encoding", {"latin-1": "ISO-8859-1"}.get(encoding, encoding))
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", infer)
    return nan_to_null(reader.csv(paths))


def _looks_like_data(name: str) -> bool:
    """Would this header cell rather be a value: number, ISO date, long hexadecimal, empty?"""
    text = name.strip()
    if not text or re.fullmatch(r"\d{4}-\d{2}-\d{2}([ T].*)?", text) or re.fullmatch(r"[0-9a-fA-F]{16,}", text):
        return True
    try:
        float(text)
    except ValueError:
        return False
    return True


def headerless(names: Sequence[str]) -> bool:
    return bool(names) and sum(map(_looks_like_data, names)) >= max(1, 0.6 * len(names))


def sniff(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """Separator and header cells of one file, as they are found in a set of files."""
    found = peek_columns(first_lines(spark, [path])).first()
    return (found["sep"], found["columns"]) if found else (",", [])


def read_delimited(spark: SparkSession, path: str | Sequence[str], infer: bool = True) -> DataFrame:
    """Any delimited text: separator, encoding and a missing header are found out, for each file by itself.

    Files without a header get the names ``c0 .. cn``.
    """
    return union_all(_by_header(spark, _paths(path), infer))


def _json_form(spark: SparkSession, paths: Sequence[str]) -> dict[bool, list[str]]:
    """Files of JSON Lines (their first mark opens an object) and others."""
    mark = F.substring(F.regexp_replace("head", "^[\ufeff\\s]+", ""), 1, 1)
    marks = {}
    if reachable(paths):
        marks = {r["path"]: r["mark"] for r in first_blocks(spark, paths).select("path", mark.alias("mark")).collect()}
    out: dict[bool, list[str]] = {}
    for p in paths:
        first = marks.get(p)
        if not first:  # blank for a whole block, or out of Python's reach
            row = spark.read.text(p).filter(F.trim("value") != "").first()
            first = row[0].lstrip("\ufeff \t")[:1] if row else ""
        out.setdefault(first == "{", []).append(p)
    return out


def read_json(spark: SparkSession, path: str | Sequence[str], lines: bool | None = None, schema=None) -> DataFrame:
    """JSON arrays and JSON Lines, told apart file by file; one read for each form."""
    paths = _paths(path)
    forms = {lines: paths} if lines is not None else _json_form(spark, paths)
    parts = []
    for form, files in sorted(forms.items()):
        reader = spark.read.option("multiLine", not form)
        parts.append((reader.schema(schema) if schema is not None else reader).json(files))
    return union_all(parts)


def record_tag(spark: SparkSession, path: str) -> str:
    """Most frequent child of the root of an XML document (streamed inside one task per file)."""

    def tags(batches: Iterable[pd.DataFrame]):
        import io
        import xml.etree.ElementTree as ET
        from collections import Counter

        for b in batches:
            for content in b["content"]:
                counts, depth = Counter(), 0
                for event, e in ET.iterparse(io.BytesIO(content), events=("start", "end")):
                    if event == "start":
                        depth += 1
                        if depth == 2:
                            counts[e.tag] += 1
                    else:
                        depth -= 1
                        if depth == 1:
                            e.clear()
                yield pd.DataFrame({"tag": list(counts), "n": list(counts.values())})

    files = spark.read.format("binaryFile").load(path).select("content")
    top = files.mapInPandas(tags, "tag string, n long").groupBy("tag").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "tag").first()
    if top is None:
        raise ValueError(f"no records below the root of {path}")
    return top["tag"]


def _flat(column: Column, kind: T.DataType, name: str) -> list[Column]:
    if isinstance(kind, T.ArrayType):  # a repeated nested tag keeps its last occurrence
        return _flat(F.element_at(column, -1), kind.elementType, name)
    if isinstance(kind, T.StructType):
        out = []
        for f in kind.fields:
            mark = "." if f.name.startswith("@") or f.name == "#text" else "_"
            leaf = isinstance(f.dataType, (T.StructType, T.ArrayType)) or mark == "."
            child = f"{name}{mark}{f.name}"
            out += _flat(column.getField(f.name), f.dataType, child if leaf else f"{child}.#text")
        return out
    return [column.alias(name)]


def read_xml(spark: SparkSession, path: str | Sequence[str], row_tag: str | None = None) -> DataFrame:
    """Records of an XML file as flat columns: ``@attribute``, ``tag.#text``, ``tag.@a``, ``tag_child...``."""
    paths = _paths(path)
    tag = row_tag or record_tag(spark, paths[0])
    df = (
        spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "@").option("valueTag", "#text")
        .option("inferSchema", False).load(paths)
    )
    out = []
    for f in df.schema.fields:
        plain = not isinstance(f.dataType, (T.StructType, T.ArrayType))
        own = f.name.startswith("@") or f.name == "#text"
        out += _flat(F.col(f"`{f.name}`"), f.dataType, f.name if own or not plain else f"{f.name}.#text")
    return df.select(*out)


_TERM = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)'
TRIPLE = rf"^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+{_TERM}\s*\.\s*(?:#.*)?$"


def read_ntriples(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """N-Triples as a set of (subject, predicate, object) texts; comments and blank lines are dropped."""
    lines = spark.read.text(_paths(path)).filter(~F.col("value").rlike(r"^\s*(#.*)?$"))

    def part(i: int) -> Column:
        raw = F.regexp_extract("value", TRIPLE, i)
        plain = F.regexp_replace(raw, r"^<(.*)>$", "$1")
        return F.regexp_replace(plain, r'^"((?:[^"\\]|\\.)*)"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?$', "$1")

    return lines.select(part(1).alias("subject"), part(2).alias("predicate"), part(3).alias("object")).distinct()


def read_xlsx(spark: SparkSession, path: str | Sequence[str], header: bool = True) -> DataFrame:
    """First sheet of many workbooks, read in parallel; one column per header cell of the first file."""

    def rows(batches: Iterable[pd.DataFrame]):
        import io
        import xml.etree.ElementTree as ET
        import zipfile

        ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    shared = []
                    if "xl/sharedStrings.xml" in z.namelist():
                        root = ET.fromstring(z.read("xl/sharedStrings.xml"))
                        shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in root.iter(f"{ns}si")]
                    sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
                    out = []
                    with z.open(sheets[0]) as f:
                        for _, e in ET.iterparse(f):
                            if e.tag == f"{ns}row":
                                out.append((p, len(out), _cells(e, ns, shared)))
                                e.clear()
                                if len(out) % 5000 == 0:
                                    yield pd.DataFrame(out[-5000:], columns=["path", "row", "cells"])
                    rest = len(out) % 5000
                    if rest:
                        yield pd.DataFrame(out[-rest:], columns=["path", "row", "cells"])

    files = spark.read.format("binaryFile").load(_paths(path)).select("path", "content")
    table = files.mapInPandas(rows, "path string, row long, cells array<string>")
    first = table.filter("row = 0").orderBy("path").first()
    if first is None:
        raise ValueError("no workbook rows found")
    names = [n or f"c{i}" for i, n in enumerate(first["cells"])] if header else [f"c{i}" for i in range(len(first["cells"]))]
    body = table.filter("row > 0") if header else table
    return body.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def _cells(row, ns, shared):
    out = []
    for c in row.iter(f"{ns}c"):
        letters = re.match(r"[A-Z]+", c.get("r", "")) if c.get("r") else None
        at = len(out)
        if letters:
            at = 0
            for ch in letters.group():
                at = at * 26 + ord(ch) - 64
            at -= 1
        out.extend([None] * (at - len(out)))
        v = c.find(f"{ns}v")
        if c.get("t") == "inlineStr":
            out.append("".join(t.text or "" for t in c.iter(f"{ns}t")))
        elif v is None:
            out.append(None)
        else:
            out.append(shared[int(v.text)] if c.get("t") == "s" else v.text)
    return out


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read a file by its extension."""
    fmt = detect_format(path)
    readers = {"csv": read_csv, "tsv": read_csv, "json": read_json, "jsonl": read_json, "xml": read_xml,
               "nt": read_ntriples, "xlsx": read_xlsx, "txt": read_delimited}
    if fmt == "parquet":
        return nan_to_null(spark.read.parquet(path))
    if fmt not in readers:
        raise UnsupportedFormat(fmt)
    return readers[fmt](spark, path, **options)


# --- many files --------------------------------------------------------------------------------


def prune_cast(df: DataFrame, columns: Mapping[str, str], date_format: str = "MM/dd/yyyy hh:mm:ss a") -> DataFrame:
    """Only the named columns: absent ones as nulls, numbers and dates coerced.

    ``columns`` maps a name to ``number``, ``long``, ``date`` or ``string``.
    """
    out = []
    for name, kind in columns.items():
        c = F.col(name) if name in df.columns else F.lit(None)
        if kind == "number":
            c = as_number(c)
        elif kind == "long":
            c = as_number(c).cast("long")
        elif kind == "date":
            c = F.try_to_timestamp(c.cast("string"), F.lit(date_format))
        elif kind == "string":
            c = c.cast("string")
        else:
            raise ValueError(f"unknown kind: {kind}")
        out.append(c.alias(name))
    return df.select(*out)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_group(spark: SparkSession, catalog: DataFrame, group: str, max_files: int | None = None) -> DataFrame:
    """All files of one catalogue group as one table."""
    files = [r["path"] for r in catalog.filter(F.col("group") == group).select("path").orderBy("path").collect()]
    files = files[:max_files] if max_files else files
    if not files:
        raise FileNotFoundError(f"no files in group {group}")
    if detect_format(files[0]) in ("csv", "tsv", "txt"):
        return union_all(_by_header(spark, files, infer=True))
    return union_all([read(spark, f) for f in files])


def _by_header(spark: SparkSession, files: Sequence[str], infer: bool, source: bool = False) -> list[DataFrame]:
    """One scan per distinct header instead of one per file."""
    heads = peek_columns(first_lines(spark, files))
    sets = heads.groupBy("columns", "sep").agg(F.collect_list("path").alias("paths")).collect()  # file names only
    parts = []
    for s in sorted(sets, key=lambda r: min(r["paths"])):
        plain = headerless(s["columns"])
        df = read_csv(spark, sorted(s["paths"]), sep=s["sep"], header=not plain, infer=infer)
        if plain:
            df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        parts.append(_tagged(df) if source else df)
    return parts


def _tagged(df: DataFrame) -> DataFrame:
    return df.withColumn(SOURCE_FILE, F.element_at(F.split(F.input_file_name(), "/"), -1))


def broken_rows(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """``(path, broken, example)`` of delimited files that hold rows with more or fewer cells than their header."""
    heads = peek_columns(first_lines(spark, files))
    sets = heads.groupBy("columns", "sep").agg(F.collect_list("path").alias("paths")).collect()  # file names only
    out = None
    for s in sets:
        names = [f"c{i}" for i in range(len(s["columns"]))]
        reader = spark.read.schema(", ".join(f"{n} string" for n in names) + ", _broken string")
        rows = reader.options(sep=s["sep"], header=not headerless(s["columns"]), quote='"', escape='"', columnNameOfCorruptRecord="_broken", columnPruning=False, enforceSchema=True).csv(s["paths"])
        bad = rows.select(F.input_file_name().alias("path"), *names, "_broken").filter("_broken IS NOT NULL")
        per = bad.groupBy("path").agg(F.count("*").alias("broken"), F.min(F.struct("_broken", names[0])).alias("one")).select("path", "broken", F.col("one._broken").alias("example"))
        per = cut(per)  # all columns at once: a scan for the broken row alone is refused
        out = per if out is None else out.union(per)
    return out if out is not None else spark.createDataFrame([], "path string, broken long, example string")


@dataclass
class Bundle:
    """Union of several files with what was read from where."""

    data: DataFrame
    sources: DataFrame
    notes: list[str]


def load_sources(spark: SparkSession, paths: Sequence[str], limit: int | None = None, infer: bool = True) -> Bundle:
    """Union files by column name; broken files are recorded, and only all of them failing raises.

    ``sources`` has a row per file with its state and, for delimited text, its rows of the wrong number of cells: how many,
    and one of them. Such rows stay in ``data``, missing cells null and surplus ones left out.
    """
    files, notes = expand(spark, paths, limit)
    if not files:
        raise FileNotFoundError("no readable files: " + "; ".join(notes))
    several = len(files) > 1
    text = [f for f in files if detect_format(f) in ("csv", "tsv", "txt")]
    parts, records = [], []
    if text:
        facts = {r["path"] for r in first_lines(spark, text).select("path").collect()}
        usable = [f for f in text if any(f.endswith(k.split(":", 1)[-1].lstrip("/")) for k in facts)]
        parts += _by_header(spark, usable, infer, several)
        records += [(f, "text", f in usable, None if f in usable else "empty file") for f in text]
    for f in files:
        if f in text:
            continue
        try:
            df = read(spark, f)
            df.schema  # noqa: B018  (reads the footer or infers, so a broken file fails here)
            parts.append(_tagged(df) if several else df)
            records.append((f, detect_format(f), True, None))
        except Exception as exc:
            records.append((f, detect_format(f), False, f"{type(exc).__name__}"))
            notes.append(f"{f}: {type(exc).__name__}")
    if not parts:
        raise RuntimeError("all files failed: " + "; ".join(notes[:3]))
    sources = spark.createDataFrame(records, "path string, format string, ok boolean, error string")
    ragged = broken_rows(spark, usable) if text and usable else spark.createDataFrame([], "path string, broken long, example string")
    bare = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")  # noqa: E731  (Spark writes a path's scheme in two ways)
    ragged = ragged.select(bare("path").alias("_p"), "broken", "example")
    sources = sources.join(F.broadcast(ragged), bare("path") == F.col("_p"), "left").drop("_p").withColumn("broken", F.coalesce("broken", F.lit(0)))  # a row per file
    return Bundle(union_all(parts), sources, notes)


def cached_stage(spark: SparkSession, path: str, build, partition_by: Sequence[str] = ()) -> DataFrame:
    """Read a stage's Parquet output when it exists, else build and write it first."""
    try:
        return spark.read.parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
            raise
    build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def entity_points(df: DataFrame, entity: str, time: str, flag: str, lat: str, lng: str) -> DataFrame:
    """(lat, lon, value) per entity: last known coordinates, value 1 when the flag was ever set."""
    last = lambda c: F.max_by(as_number(c), F.when(F.col(c).isNotNull(), F.col(time)))
    return df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(
        last(lat).alias("lat"), last(lng).alias("lon"), F.max(F.when(F.col(flag).isNotNull(), 1).otherwise(0)).alias("value")
    ).select("lat", "lon", F.col("value").cast("double").alias("value"))


def count_points(df: DataFrame, lat: str, lng: str) -> DataFrame:
    """(lat, lon, 1) for every trip or check-in."""
    return df.select(as_number(lat).alias("lat"), as_number(lng).alias("lon"), F.lit(1.0).alias("value"))
