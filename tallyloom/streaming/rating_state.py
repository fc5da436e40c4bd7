"""Ratings kept up to date by a stream of matches, without a refit.

State is kept by component (teams that are connected by opponents), in three tables of one folder an epoch:

    teams   team, component, elo, last_date, last_id     of the components that the batch touched
    log     the batch's matches
    out     match_id, elo_h, elo_a                       of matches rated, or rated anew, in the batch

A batch joins its matches with their teams' components.  Matches between components merge them: those ratings stand, as the
teams had no influence on each other before.  A match is late if one of its teams has played a later one; then the ratings
that followed are wrong, and the component is replayed from the log, with the late match in its place.  Components that
are touched but not late go on from their state.  The last epoch that names a team, or a match, counts; a batch that is run again
overwrites its own epoch and reads earlier ones only, so it leaves the same.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ratings import components

MATCH = "match_id long, date date, home long, away long, score double, weight double"
TEAM = "team long, component long, elo double, last_date date, last_id long"
DONE = "kind int, id long, component long, elo double, elo_a double, last_date date, last_id long"


def _latest(rows: DataFrame, key: str, epoch: str = "epoch") -> DataFrame:
    others = [c for c in rows.columns if c not in (key, epoch)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), epoch).alias("x")).select(key, "x.*")


class RatingState:
    """The state below `base`; `refresh` is a foreachBatch function."""

    def __init__(self, spark: SparkSession, base: str, home_edge: float = 68.0, start: float = 1500.0, every: int = 16):
        self.spark, self.base, self.home_edge, self.start, self.every = spark, base, home_edge, start, every

    def _read(self, name: str, schema: str, epochs: range) -> DataFrame:
        out = self.spark.createDataFrame([], f"{schema}, epoch int")
        for e in epochs:
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.base}/{name}/epoch={e}").withColumn("epoch", F.lit(e)))
        return out

    def teams(self, epoch: int) -> DataFrame:
        """Every team's state before an epoch: the last snapshot, which is written every so many epochs, and what came after it."""
        last = epoch - epoch % self.every
        deltas = self._read("teams", TEAM, range(last, epoch))
        if last:
            deltas = deltas.unionByName(self.spark.read.schema(TEAM).parquet(f"{self.base}/snapshot/epoch={last}").withColumn("epoch", F.lit(-1)))
        return _latest(deltas, "team")

    def ratings(self) -> DataFrame:
        """(match_id, elo_h, elo_a): each match as it was rated last."""
        return _latest(self.spark.read.schema("match_id long, elo_h double, elo_a double, epoch int").parquet(f"{self.base}/out"), "match_id")

    def _replay(self):
        edge, start = self.home_edge, self.start

        def run(key, own: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            rating = dict(zip(old["team"], old["elo"]))
            last = dict(zip(old["team"], zip(old["last_date"], old["last_id"])))
            rows = []
            for m in own.sort_values(["date", "match_id"]).itertuples(index=False):
                eh, ea = rating.get(m.home, start), rating.get(m.away, start)
                step = m.weight * (m.score - 1.0 / (1.0 + 10.0 ** ((ea - (eh + edge)) / 400.0)))
                rating[m.home], rating[m.away] = eh + step, ea - step
                last[m.home] = last[m.away] = (m.date, m.match_id)
                rows.append((1, m.match_id, key[0], eh, ea, None, None))
            rows += [(2, t, key[0], r, None, *last[t]) for t, r in rating.items()]
            return pd.DataFrame(rows, columns=["kind", "id", "component", "elo", "elo_a", "last_date", "last_id"])

        return run

    def refresh(self, df: DataFrame, epoch: int, _out: str | None = None) -> None:
        spark, base = self.spark, self.base
        if epoch and epoch % self.every == 0:
            self._snapshot(epoch)
        df.select(*[c.split()[0] for c in MATCH.split(", ")]).dropDuplicates(["match_id"]).write.mode("overwrite").parquet(f"{base}/log/epoch={epoch}")
        new = spark.read.schema(MATCH).parquet(f"{base}/log/epoch={epoch}")
        teams = self.teams(epoch)

        side = lambda s: teams.select(F.col("team").alias(s), F.col("component").alias(f"{s}_c"), F.struct("last_date", "last_id").alias(f"{s}_last"))
        known = new.join(side("home"), "home", "left").join(side("away"), "away", "left").withColumn("at", F.struct("date", F.col("match_id").alias("id")))
        # a new team is its own component, numbered like no component of known teams: those have their smallest team's number
        known = known.withColumns({f"{s}_c": F.coalesce(f"{s}_c", s) for s in ("home", "away")})
        late = F.coalesce(F.col("home_last") >= F.col("at"), F.lit(False)) | F.coalesce(F.col("away_last") >= F.col("at"), F.lit(False))
        known = known.withColumn("late", late)
        merged = components(known.select(F.col("home_c").alias("home"), F.col("away_c").alias("away"))).select(F.col("team").alias("old"), F.col("component").alias("top"))
        known = known.join(merged, F.col("home_c") == F.col("old")).drop("old")
        lates = known.groupBy("top").agg(F.max("late").alias("late"))
        touched = teams.join(merged, teams["component"] == F.col("old")).drop("old", "component").join(lates, "top")
        plain = [c.split()[0] for c in MATCH.split(", ")]
        going = known.join(lates.where("not late"), "top", "left_semi").select("top", *plain)
        if known.where("late").limit(1).count():
            members = touched.where("late").select("top", "team").union(known.join(lates.where("late"), "top", "left_semi").select("top", F.explode(F.array("home", "away")))).distinct()
            history = self._read("log", MATCH, range(epoch + 1)).drop("epoch").dropDuplicates(["match_id"])
            going = going.unionByName(history.join(members.withColumnRenamed("team", "home"), "home").select("top", *plain))
        kept = touched.where("not late").select(F.col("top").alias("of"), "team", "elo", "last_date", "last_id")
        done = going.groupBy("top").cogroup(kept.groupBy("of")).applyInPandas(self._replay(), DONE)
        done.write.mode("overwrite").parquet(f"{base}/done/epoch={epoch}")
        done = spark.read.schema(DONE).parquet(f"{base}/done/epoch={epoch}")
        done.where("kind = 2").select(F.col("id").alias("team"), "component", "elo", "last_date", "last_id").write.mode("overwrite").parquet(f"{base}/teams/epoch={epoch}")
        done.where("kind = 1").select(F.col("id").alias("match_id"), F.col("elo").alias("elo_h"), "elo_a").write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    def _snapshot(self, epoch: int) -> None:
        before = epoch - self.every
        rows = self._read("teams", TEAM, range(before, epoch))
        if before:
            rows = rows.unionByName(self.spark.read.schema(TEAM).parquet(f"{self.base}/snapshot/epoch={before}").withColumn("epoch", F.lit(-1)))
        _latest(rows, "team").write.mode("overwrite").parquet(f"{self.base}/snapshot/epoch={epoch}")
