"""Matching predictions with results, records, point-in-time and validity lookups, routing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def new_only(rows: DataFrame, have: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not there yet (nulls in a key are equal)."""
    on = [F.col(f"n.{k}").eqNullSafe(F.col(f"h.{k}")) for k in key]
    return rows.alias("n").join(have.select(*key).distinct().alias("h"), on, "left_anti")


def best_first(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in `order`."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def superseded(rows: DataFrame, key: list[str], source: str = "source", placeholder: str = "placeholder") -> DataFrame:
    """One row a key; one from a full source wins over a placeholder, then the smaller match_id."""
    return best_first(rows, key, F.when(F.col(source) == placeholder, 1).otherwise(0), F.col("match_id"))


def settle_within(pending: DataFrame, results: DataFrame, days: int = 3) -> DataFrame:
    """Each prediction (pid, div, home, away, date) with the first result of the same sides within `days` of its date."""
    p, r = pending.alias("p"), results.alias("r")
    same = [F.col(f"p.{k}") == F.col(f"r.{k}") for k in ("div", "home", "away")]
    joined = p.join(r, [*same, F.col("r.date").between(F.date_sub("p.date", days), F.date_add("p.date", days))])
    out = joined.select("p.pid", F.col("r.match_id").alias("match_id"), F.col("r.date").alias("played"), "r.hg", "r.ag")
    return best_first(out, ["pid"], F.col("played"), F.col("match_id"))


def settle_by_id(pending: DataFrame, manual: DataFrame, feed: DataFrame, today: Column, keep_days: int = 14) -> DataFrame:
    """Status of each prediction (id, date): graded (a manual result wins over the feed's), pending, or dropped as too old."""
    results = manual.withColumn("rank", F.lit(0)).unionByName(feed.withColumn("rank", F.lit(1)))
    results = best_first(results, ["id"], F.col("rank"))
    out = pending.join(results, "id", "left")
    status = F.when(F.col("hg").isNotNull(), "graded").when(F.datediff(today, "date") > keep_days, "dropped").otherwise("pending")
    return out.select("id", "date", "hg", "ag", status.alias("status"))


def as_of(events: DataFrame, series: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """`events` with the last value of the series strictly before their time.

    The series is first reduced to its final value at each time.  Both are put into one sort by key and time, in which an
    event comes before a value of the same time, so one shuffle and one pass do.
    """
    final = series.groupBy(key, ts).agg(F.max_by(value, "ord").alias("_v"))
    cols = [c for c in events.columns if c not in (key, ts)]
    left = events.select(key, ts, F.lit(0).alias("_kind"), F.struct(*cols).alias("_row"), F.lit(None).cast(dict(final.dtypes)["_v"]).alias("_v"))
    right = final.select(key, ts, F.lit(1).alias("_kind"), F.lit(None).cast(dict(left.dtypes)["_row"]).alias("_row"), "_v")
    spec = W.partitionBy(key).orderBy(ts, "_kind").rowsBetween(W.unboundedPreceding, 0)
    return left.unionByName(right).withColumn(f"{value}_before", F.last("_v", ignorenulls=True).over(spec)).where("_kind = 0").select(key, ts, "_row.*", f"{value}_before")


def valid_at(asked: DataFrame, periods: DataFrame, key: str) -> DataFrame:
    """`asked` (key, day, qid) with the value of the period that covers the day, else of the key's latest period.

    periods: key, start, finish, value.  They may overlap or nest: of several that cover a day the one begun last counts, of
    these the one that ends first.  Both sides go into one sort by key and day; a pass over each partition keeps the periods
    that are still open, innermost on top, and drops those that a later one outlives, so it holds no more than are nested.
    """
    cols = [c for c in asked.columns if c not in (key, "day")]
    kinds = dict(asked.dtypes), dict(periods.dtypes)
    left = periods.select(key, F.col("start").alias("day"), F.lit(0).alias("_kind"), F.col("finish").alias("_finish"), F.col("value").alias("_value"), *[F.lit(None).cast(kinds[0][c]).alias(c) for c in cols])
    right = asked.select(key, "day", F.lit(1).alias("_kind"), F.lit(None).cast(kinds[1]["finish"]).alias("_finish"), F.lit(None).cast(kinds[1]["value"]).alias("_value"), *cols)
    both = left.unionByName(right).repartition(key).sortWithinPartitions(key, "day", "_kind", F.desc("_finish"))
    schema = T.StructType([both.schema[key], both.schema["day"], *[both.schema[c] for c in cols], T.StructField("value", both.schema["_value"].dataType), T.StructField("exact", T.BooleanType())])

    def sweep(batches):
        now, open_ = object(), []
        for batch in batches:
            taken, values, exact = [], [], []
            for n, (k, day, kind, finish, value) in enumerate(zip(*(batch.column(c).to_pylist() for c in (key, "day", "_kind", "_finish", "_value")))):
                if k != now:
                    now, open_ = k, []
                while open_ and open_[-1][0] < day:
                    open_.pop()
                if kind == 0 and finish is not None and finish >= day:
                    while open_ and open_[-1][0] <= finish:
                        open_.pop()
                    open_.append((finish, value))
                elif kind == 1:
                    taken.append(n)
                    values.append(open_[-1][1] if open_ else None)
                    exact.append(bool(open_))
            rows = batch.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(key), rows.column("day"), *[rows.column(c) for c in cols], pa.array(values, batch.schema.field("_value").type), pa.array(exact)], [key, "day", *cols, "value", "exact"])

    last = periods.groupBy(key).agg(F.max_by("value", F.struct("start", "finish")).alias("_last"))
    found = both.mapInArrow(sweep, schema).join(last, key, "left")
    return found.select(*asked.columns, F.when(F.col("exact"), F.col("value")).otherwise(F.col("_last")).alias("value"), "exact")


#: What an unseen team is taken to be.
DEFAULTS = {"elo": 1500.0, "gf": 1.3, "ga": 1.3, "form": 0.5, "sot": 4.4}


def both_sides(fixtures: DataFrame, state: DataFrame, defaults: dict = DEFAULTS) -> DataFrame:
    """Each fixture with both teams' state (team, ...); unseen teams get the defaults."""
    cols = [c for c in state.columns if c != "team"]
    out = fixtures
    for side, p in (("home", "h"), ("away", "a")):
        own = state.select(F.col("team").alias(side), *[F.col(c).alias(f"{p}_{c}") for c in cols], F.lit(True).alias(f"{p}_known"))
        out = out.join(own, side, "left").withColumns({f"{p}_{c}": F.coalesce(f"{p}_{c}", F.lit(defaults[c])) for c in cols if c in defaults}).withColumn(f"{p}_known", F.coalesce(f"{p}_known", F.lit(False)))
    return out


def coverage(fixtures: DataFrame, state: DataFrame) -> DataFrame:
    """covered, reason and route: the core model needs both teams known in the same division."""
    out = both_sides(fixtures, state.select("team", F.col("div").alias("own_div")), {})
    reason = (F.when(~F.col("h_known") & ~F.col("a_known"), "both unknown").when(~F.col("h_known"), "home unknown").when(~F.col("a_known"), "away unknown")
              .when(F.col("h_own_div") != F.col("a_own_div"), "different divisions"))
    out = out.withColumn("reason", reason).withColumn("covered", reason.isNull())
    route = F.when(F.col("covered"), "core").when(F.col("h_known") & F.col("a_known"), "external").otherwise("unrated")
    return out.withColumn("route", route)


def decayed(state: DataFrame, day: Column) -> DataFrame:
    """(team, elo, days_out, weight, decayed): ratings of absent teams drawn to the mean of their division."""
    from ..functions.odds import stale_weight

    means = state.groupBy("div").agg(F.avg("elo").alias("anchor"))
    cutoff = state.agg(F.max("last_date").alias("cutoff"))  # one row
    rows = state.join(means, "div").join(cutoff, how="cross")
    days = F.greatest(F.datediff(F.least(day, "cutoff"), "last_date"), F.lit(0))
    weight = stale_weight(days)
    return rows.select("team", "elo", days.alias("days_out"), weight.alias("weight"), (F.col("anchor") + (F.col("elo") - F.col("anchor")) * weight).alias("decayed"))
