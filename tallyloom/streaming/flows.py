"""Structured Streaming twins of the batch operators.  Each drains its input with AvailableNow into Parquet.

State is bounded by watermarks: windows and sessions are written once, when the watermark has passed them, and keys are
forgotten with their time.  A feed may end with a marker, one row far in the future, which lets everything before it close.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_base


def shared(spark: SparkSession) -> str:
    """A new folder where all executors can write."""
    return f"{shared_base(spark)}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, df: DataFrame, files: int = 4, order: str | None = None, width: int = 2, end: str | None = None, marker: dict | None = None) -> DataFrame:
    """`df` as a file stream of `files` micro-batches of `width` files, which as many tasks write.

    With `order`, the batches follow one another in its order; with `end`, a timestamp column, a last batch holds one row
    ten years after the others, whose other columns are those of `marker`, or null.  Give a marker the keys of a join: rows
    with null keys are filtered out before they move the watermark.
    """
    base = shared(spark)
    if order is None:
        df.repartition(files * width).write.parquet(f"{base}/in")
    else:
        df.write.parquet(f"{base}/all")
        rows = spark.read.schema(df.schema).parquet(f"{base}/all").withColumn("_s", F.unix_timestamp(F.col(order).cast("timestamp")).cast("double"))
        cuts = rows.approxQuantile("_s", [k / files for k in range(1, files)], 0.01)
        edges = [None, *sorted(set(cuts)), None]
        for low, high in zip(edges, edges[1:]):
            part = rows.where((F.col("_s") > low if low is not None else F.lit(True)) & (F.col("_s") <= high if high is not None else F.lit(True)))
            part.drop("_s").repartition(width).write.mode("append").parquet(f"{base}/in")
    if end is not None:
        far = df.agg((F.max(end) + F.expr("interval 10 years")).cast(df.schema[end].dataType).alias(end))
        far.select(*[F.col(c) if c == end else F.lit((marker or {}).get(c)).cast(t).alias(c) for c, t in df.dtypes]).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", width).parquet(f"{base}/in")


def drained(stream: DataFrame, mode: str = "append", batch=None, progress: list | None = None) -> DataFrame:
    """Runs a stream to its end and returns what it wrote; `progress` gets the reports of its batches."""
    spark = stream.sparkSession
    base = shared(spark)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if batch is not None:
        q = writer.foreachBatch(lambda df, epoch: batch(df, epoch, f"{base}/out")).start()
    else:
        q = writer.format("parquet").start(f"{base}/out")
    q.awaitTermination()
    if progress is not None:
        progress += q.recentProgress
    schema = stream.schema if batch is None else None
    return (spark.read.schema(schema) if schema else spark.read).parquet(f"{base}/out")


def new_keys(stream: DataFrame, key: list[str], ts: str, delay: str, have: DataFrame | None = None) -> DataFrame:
    """The first row of each key that `have` doesn't hold.  The key has the time `ts` in it, so a key's state goes when the
    watermark passes its time, and nothing that was written before is read again."""
    new = stream if have is None else stream.join(have.select(*key), key, "left_anti")
    return new.withWatermark(ts, delay).dropDuplicates(key)


def first_in_window(stream: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """The first arrival of each key within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def settled(predictions: DataFrame, results: DataFrame, days: int = 3, expiry: float | None = None) -> DataFrame:
    """Stream-stream join of predictions and results of the same sides within `days`; both sides' state is bounded by watermarks.

    With `expiry`, predictions without a result come out, too, with nulls, as soon as no result later than `expiry` days
    after them is awaited: the results' watermark trails by expiry - days, so the join lets go of them just then.

    A prediction has one bin of time, a result each bin that it may be near to, so a row meets what is around its time, not all
    that the sides have in the state.  A day more than `days` covers any change of the session's clock.
    """
    behind = f"{days + 1} days" if expiry is None else f"{int((expiry - days) * 24)} hours"
    span, width = days + 1, 7 * (days + 1)
    bin_of = lambda ts, shift: F.floor((F.unix_timestamp(ts) + shift * 86400) / (width * 86400))
    p = predictions.withWatermark("p_ts", f"{days + 1} days" if expiry is None else "1 day").withColumn("bin", bin_of("p_ts", 0)).alias("p")
    r = results.withWatermark("r_ts", behind).withColumn("bin", F.explode(F.sequence(bin_of("r_ts", -span), bin_of("r_ts", span)))).alias("r")
    near = F.expr(f"r.r_ts >= p.p_ts - interval {days} days and r.r_ts <= p.p_ts + interval {days} days")
    same = [F.col(f"p.{c}") == F.col(f"r.{c}") for c in ("home", "away", "bin")]
    return p.join(r, same[0] & same[1] & same[2] & near, "inner" if expiry is None else "left_outer").drop("bin")


def tumbling(stream: DataFrame, width: str, *aggregates, keys=(), delay: str = "1 day", slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Windows that are written once, when the watermark has passed their end."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, delay).groupBy(w.alias("w"), *keys).agg(*aggregates)


def distinct_in_windows(stream: DataFrame, width: str, slide: str, item: str, delay: str = "1 day") -> DataFrame:
    """(w, n, items): rows and distinct items of sliding windows.  Items are counted by window first and these counts by
    window again, so a window's items are rows of state that are spread over tasks, never a set in one row."""
    each = tumbling(stream, width, F.count("*").alias("n"), keys=(item,), delay=delay, slide=slide)
    return each.groupBy("w").agg(F.sum("n").alias("n"), F.count(item).alias("items"))


def stale(stream: DataFrame, key: str, gap: str, delay: str = "1 day") -> DataFrame:
    """(key, last_seen): written when a key has been silent for `gap`; a key that comes back and falls silent again is written again."""
    spells = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.max("ts").alias("last_seen"))
    return spells.select(key, "last_seen")


def upserts(merge):
    """foreachBatch: writes what a batch has, merged within itself, as one more delta.  `merge` must give the same whatever is
    merged first; then readers merge the deltas, and the bytes a batch writes don't grow with the table."""
    def run(df: DataFrame, epoch: int, out: str) -> None:
        merge(df).write.mode("overwrite").parquet(f"{out}/v={epoch}")

    return run
