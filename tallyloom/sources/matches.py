"""Matches: the two-row team form, and the adapter that reads matches out of the order tables.

A match has match_id, date, div, home, away, hg, ag, neutral, stage, hst, ast, cards, referee and prices (oh, od, oa before
the match; ch, cd, ca at its start).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with lines is a match in the division of its customer's nation; 12 teams a division."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = read("lineitem").groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("sk"), F.max("l_quantity").cast("long").alias("qx"), F.min("l_quantity").cast("long").alias("qn"),
        F.min("l_partkey").alias("pk"), F.floor(F.max("l_extendedprice")).alias("p"))
    orders = read("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    customers = read("customer").select("c_custkey", "c_nationkey")
    rows = orders.join(lines, orders.o_orderkey == lines.l_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    slot = F.expr("(c_custkey div 25) % 12")

    def price(low: int, by: int, span: int):
        return (low + F.expr(f"(p div {by}) % {span}")) / F.lit(100.0)

    has_shots, has_close = F.col("o_orderkey") % 7 != 0, F.col("p") % 5 != 0
    return rows.select(
        F.col("o_orderkey").alias("match_id"), F.to_date("o_orderdate").alias("date"), F.col("c_nationkey").alias("div"),
        (F.col("c_nationkey") * 100 + slot).alias("home"), (F.col("c_nationkey") * 100 + (slot + 1 + F.col("sk") % 11) % 12).alias("away"),
        (F.col("qx") % 5).cast("int").alias("hg"), (F.col("pk") % 4).cast("int").alias("ag"),
        (F.col("o_orderstatus") == "P").alias("neutral"), F.col("o_orderpriority").alias("stage"),
        F.when(has_shots, (F.col("qx") % 9).cast("int")).alias("hst"), F.when(has_shots, (F.col("qn") % 8).cast("int")).alias("ast"),
        (F.col("pk") % 7).cast("int").alias("cards"), F.when(F.col("sk") % 10 != 0, F.col("sk") % 40).alias("referee"),
        F.when(F.col("p") % 11 != 0, price(105, 1, 400)).otherwise(1.0).alias("oh"), price(200, 7, 300).alias("od"), price(105, 3, 500).alias("oa"),
        F.when(has_close, price(105, 2, 400)).alias("ch"), F.when(has_close, price(200, 5, 300)).alias("cd"), F.when(has_close, price(105, 9, 500)).alias("ca"))


def points(scored: str, conceded: str):
    return F.when(F.col(scored) > F.col(conceded), 3).when(F.col(scored) == F.col(conceded), 1).otherwise(0)


def team_matches(m: DataFrame) -> DataFrame:
    """Two rows a match, one from each team's side; unplayed matches (null goals) stay out."""
    both = F.array(
        F.struct(F.col("home").alias("team"), F.lit(True).alias("is_home"), F.col("away").alias("other"), F.col("hg").alias("gf"), F.col("ag").alias("ga"), points("hg", "ag").alias("pts"), F.col("hst").alias("sf"), F.col("ast").alias("sa")),
        F.struct(F.col("away").alias("team"), F.lit(False).alias("is_home"), F.col("home").alias("other"), F.col("ag").alias("gf"), F.col("hg").alias("ga"), points("ag", "hg").alias("pts"), F.col("ast").alias("sf"), F.col("hst").alias("sa")))
    return m.where("hg is not null and ag is not null").select("match_id", "date", "div", "cards", F.explode(both).alias("s")).select("s.team", "match_id", "date", "div", "s.is_home", "s.other", "s.gf", "s.ga", "s.pts", "s.sf", "s.sa", "cards")
