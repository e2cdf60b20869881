"""Run registered queries next to their SQL and compare the full results."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)

    def text(v):
        if v is None or (not isinstance(v, (str, list)) and pd.isna(v)):
            return "NULL"
        if isinstance(v, bool):
            return str(int(v))
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return repr(v + 0.0)
        return str(v)

    return sorted(tuple(text(v) for v in row) for row in pdf[cols].itertuples(index=False))


def kinds(pdf: pd.DataFrame) -> dict[str, str]:
    return {c: "text" if pdf[c].dtype.kind in "OSU" else "number" for c in sorted(pdf.columns)}


def compare(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} vs {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    a, b = canonical(left), canonical(right)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} rows differ ({sorted(left.columns)}), first: {bad[:2]}"
    return None


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries

    from geostrata.session import build_session

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": os.environ.get("SHUFFLE", "8"), "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{TESTDATA}/sf{sf}"
    con, sqls, failed = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - start
            if name in sqls:
                t1 = time.time()
                want = con.execute(sqls[name]).fetchdf()
                problem = compare(got, want)
                took_sql = time.time() - t1
                state = "ok" if problem is None else f"DIFF {problem}"
            else:
                state, took_sql = "rows only", 0.0
        except Exception as exc:
            took, took_sql, state, got = time.time() - start, 0.0, f"ERROR {str(exc)[:600]}", []
        failed += state.startswith(("DIFF", "ERROR"))
        if state != "ok" or took > 6 or os.environ.get("VERBOSE"):
            print(f"{name:28s} {len(got):7d} rows {took:6.1f}s sql {took_sql:5.1f}s  {state}", flush=True)
    print("failed:", failed)
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
