"""The registry of queries and of the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with its SQL twin if there is one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six decimals and no negative zero: what both engines print alike."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """All double columns to six decimals."""
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


#: The match adapter in SQL: each order with lines is a match (see sources.matches).
M_SQL = """
WITH RECURSIVE per_order AS (
  SELECT l_orderkey, min(l_suppkey) AS sk, max(l_quantity)::BIGINT AS qx, min(l_quantity)::BIGINT AS qn, min(l_partkey) AS pk,
         floor(max(l_extendedprice))::BIGINT AS p
  FROM lineitem GROUP BY l_orderkey),
m AS (
  SELECT o_orderkey AS match_id, o_orderdate::DATE AS date, c_nationkey AS div,
    c_nationkey * 100 + (c_custkey // 25) % 12 AS home,
    c_nationkey * 100 + ((c_custkey // 25) % 12 + 1 + sk % 11) % 12 AS away,
    (qx % 5)::INTEGER AS hg, (pk % 4)::INTEGER AS ag,
    o_orderstatus = 'P' AS neutral, o_orderpriority AS stage,
    CASE WHEN o_orderkey % 7 <> 0 THEN (qx % 9)::INTEGER END AS hst, CASE WHEN o_orderkey % 7 <> 0 THEN (qn % 8)::INTEGER END AS ast,
    (pk % 7)::INTEGER AS cards, CASE WHEN sk % 10 <> 0 THEN sk % 40 END AS referee,
    CASE WHEN p % 11 <> 0 THEN (105 + p % 400) / 100.0::DOUBLE ELSE 1.0 END AS oh, (200 + (p // 7) % 300) / 100.0::DOUBLE AS od, (105 + (p // 3) % 500) / 100.0::DOUBLE AS oa,
    CASE WHEN p % 5 <> 0 THEN (105 + (p // 2) % 400) / 100.0::DOUBLE END AS ch, CASE WHEN p % 5 <> 0 THEN (200 + (p // 5) % 300) / 100.0::DOUBLE END AS cd,
    CASE WHEN p % 5 <> 0 THEN (105 + (p // 9) % 500) / 100.0::DOUBLE END AS ca
  FROM orders JOIN per_order ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey),
tm AS (
  SELECT home AS team, match_id, date, div, true AS is_home, away AS other, hg AS gf, ag AS ga,
         CASE WHEN hg > ag THEN 3 WHEN hg = ag THEN 1 ELSE 0 END AS pts, hst AS sf, ast AS sa, cards FROM m
  UNION ALL
  SELECT away, match_id, date, div, false, home, ag, hg, CASE WHEN ag > hg THEN 3 WHEN hg = ag THEN 1 ELSE 0 END, ast, hst, cards FROM m)
"""


def r6_sql(x: str) -> str:
    return f"round({x}, 6) + 0.0"
