"""Evaluation as aggregations: each is one pass with partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def share(condition: Column) -> Column:
    """Share of rows (null counts as no) that meet a condition."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def log_loss(p: Column, floor: float = 1e-9) -> Column:
    return F.avg(-F.log(F.greatest(p, F.lit(floor))))


def brier(p: Column, hit: Column) -> Column:
    return F.avg(F.pow(p - hit.cast("double"), 2))


def reliability(df: DataFrame, p: Column, hit: Column, bins: int = 10) -> DataFrame:
    """Mean prediction and observed rate by bin of the prediction."""
    rows = df.select(F.least(F.floor(p * bins), F.lit(bins - 1)).alias("bin"), p.alias("p"), hit.cast("double").alias("hit"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("hit").alias("observed"))


def sweep(df: DataFrame, values: list[float], *aggregates: Column, where: Column | None = None, name: str = "t") -> DataFrame:
    """Aggregates for each of a short list of thresholds; the rows are repeated before a partial aggregation, never shuffled whole."""
    rows = df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return (rows.where(where) if where is not None else rows).groupBy(name).agg(*aggregates)


def paired(df: DataFrame, first: str, second: str) -> DataFrame:
    """Mean difference of two models' losses and its t statistic."""
    diff = F.col(first) - F.col(second)
    return df.agg(F.count("*").alias("n"), F.avg(diff).alias("mean"), (F.avg(diff) / (F.stddev_samp(diff) / F.sqrt(F.count("*")))).alias("t"))


def bootstrap(df: DataFrame, key: str, value: Column, replicas: int = 50) -> DataFrame:
    """(rep, mean) of Poisson(1) resamples; weights come from a hash of row and replica, so reruns agree."""
    rows = df.select(key, value.alias("v"), F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("rep"))
    u = F.pmod(F.xxhash64(key, "rep"), F.lit(1_000_003)) / 1_000_003
    weight, edge, mass = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        edge += mass
        mass /= k
        weight = F.when(u >= edge, k).otherwise(weight)
    rows = rows.withColumn("w", weight)
    return rows.groupBy("rep").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("mean"))


def gaps(tm: DataFrame) -> DataFrame:
    """Days between a team's matches."""
    return tm.select("team", "match_id", F.datediff("date", F.lag("date").over(W.partitionBy("team").orderBy("date", "match_id"))).alias("gap")).where("gap is not null")


def draw_curve(df: DataFrame, gap: Column, draw: Column, width: float = 40.0) -> DataFrame:
    """A and C of draw = A * exp(-gap / C): weighted least squares on the logarithm of the draw rate by bin of the gap, in closed form."""
    bins = df.groupBy(F.floor(F.abs(gap) / width).alias("bin")).agg(F.count("*").alias("n"), F.avg(draw.cast("double")).alias("rate")).where("rate > 0")
    x, y, n = (F.col("bin") + 0.5) * width, F.log("rate"), F.col("n")
    s = bins.agg(F.sum(n).alias("n"), F.sum(n * x).alias("x"), F.sum(n * y).alias("y"), F.sum(n * x * x).alias("xx"), F.sum(n * x * y).alias("xy"))
    slope = (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / (F.col("n") * F.col("xx") - F.col("x") * F.col("x"))
    return s.select(F.exp((F.col("y") - slope * F.col("x")) / F.col("n")).alias("a"), (-1 / slope).alias("c"))


def paired_bootstrap(df: DataFrame, key: str, a: Column, b: Column, replicas: int = 100, level: float = 0.95) -> DataFrame:
    """(n, mean, low, high, p_better) of a - b, both losses: the mean difference, its interval by percentiles of Poisson(1)
    resamples, and the share of resamples in which `a` is smaller.

    A row has one weight a replica, for both models, from a hash of key and replica; tasks sum before anything is shuffled.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("rep").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296
    rows = df.select(key, (a - b).alias("d"), F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("rep")).withColumn("u", u)
    weight, edge, mass = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        edge += mass
        mass /= k
        weight = F.when(F.col("u") >= edge, k).otherwise(weight)
    reps = rows.withColumn("w", weight).groupBy("rep").agg((F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("mean"))
    tail = (1 - level) / 2
    whole = df.agg(F.count("*").alias("n"), F.avg(a - b).alias("mean"))  # one row each
    spread = reps.agg(F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"), F.avg((F.col("mean") < 0).cast("int")).alias("p_better"))
    return whole.join(spread, how="cross")
