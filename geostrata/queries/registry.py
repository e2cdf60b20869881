"""Registration of queries and the shared input views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geostrata.functions.columns import rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Input views that give the tables coordinates, nulls, closures and scores. The same text is used
# for Spark (braces filled with tables) and for the oracle (braces removed).
VIEWS = {
    "fx_panel": """
SELECT o_custkey AS entity, CAST(year(o_orderdate) AS BIGINT) AS year,
       SUM(o_totalprice) AS value, COUNT(*) AS n_orders
FROM {orders} GROUP BY o_custkey, year(o_orderdate)""",
    "fx_dim": """
SELECT c.c_custkey AS entity, c.c_mktsegment AS class, CAST(c.c_nationkey AS BIGINT) AS region,
       c.c_custkey % 40 AS bank,
       CASE WHEN c.c_custkey % 29 = 0 THEN NULL
            ELSE 36 + CAST((c.c_custkey * 7919) % 9973 AS DOUBLE) / CAST(9973 AS DOUBLE) * 2 END AS lat,
       CASE WHEN c.c_custkey % 29 = 0 THEN NULL
            ELSE -100 + CAST((c.c_custkey * 104729) % 9967 AS DOUBLE) / CAST(9967 AS DOUBLE) * 2 END AS lng,
       p.first_year, p.last_year,
       CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE p.first_year - c.c_custkey % 9 END AS est_year,
       CASE WHEN c.c_custkey % 3 = 0 THEN p.last_year END AS acq_year
FROM {customer} c JOIN (SELECT o_custkey AS entity, CAST(MIN(year(o_orderdate)) AS BIGINT) AS first_year,
       CAST(MAX(year(o_orderdate)) AS BIGINT) AS last_year FROM {orders} GROUP BY o_custkey) p
  ON p.entity = c.c_custkey""",
    "fx_dirty": """
SELECT o_orderkey AS id, o_custkey AS entity, CAST(year(o_orderdate) AS BIGINT) AS year,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN -o_totalprice
            ELSE o_totalprice END AS amount,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS cat,
       CASE WHEN o_orderkey % 53 = 0 THEN CAST(95 AS DOUBLE)
            ELSE CAST(o_orderkey % 180 AS DOUBLE) - 90 END AS lat,
       CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 100 AS STRING) END AS num_text, 0 AS copy
FROM {orders}
UNION ALL
SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS BIGINT), o_totalprice + 1, o_orderpriority,
       CAST(o_orderkey % 180 AS DOUBLE) - 90, '7', 1
FROM {orders} WHERE o_orderkey % 50 = 0""",
    "fx_points": """
SELECT event_id AS id, user_id, event_type, value,
       36 + CAST((event_id * 7919) % 997 AS DOUBLE) / CAST(997 AS DOUBLE) * 0.5 AS lat,
       -100 + CAST((event_id * event_id) % 991 AS DOUBLE) / CAST(991 AS DOUBLE) * 0.5 AS lng
FROM {events}""",
    "fx_score": """
SELECT c_custkey AS entity, 1995 + c_custkey % 7 AS year, 1 + c_custkey % 12 AS duration,
       CAST((c_custkey * 31) % 101 AS DOUBLE) / CAST(101 AS DOUBLE) AS risk,
       CASE WHEN (c_custkey * 17) % 101 < 10 + (c_custkey * 31) % 101 / 4 THEN 1 ELSE 0 END AS event,
       c_mktsegment AS grp
FROM {customer}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def with_views(sql: str) -> str:
    """Put the input views that a text mentions in front of it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql.strip()
    ctes = ",\n".join(f"{v} AS ({re.sub(r'[{}]', '', VIEWS[v]).strip()})" for v in used)
    body = sql.strip()
    if re.match(r"(?i)with\b", body):
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Register a query and, when there is one, its equivalent SQL."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """bigint / rounded double / string columns only, so results compare across engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegralType, T.BooleanType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.NumericType):
            c = rounded(c, digits)
        out.append(c.alias(f.name))
    return df.select(*out)


def R(expr: str, digits: int = 6) -> str:
    return f"(ROUND(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def L(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"
