"""Sequential two-sided ratings.

Each match reads both teams' ratings and then moves them by K * margin * (score - expectation), so it is no window.  Matches
of teams that are not connected by a chain of opponents commute: components are found on the distinct pairs of opponents and
replayed in parallel, each in time order.  A component's rows (narrow columns) are sorted by Spark and stream through one task
in batches, which holds no more than a rating a team; a single component that holds everything is replayed by one task, which
is the limit of exact sequential replay.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import shared_base

OUT = "match_id long, elo_h double, elo_a double, exp_h double, elo_h_post double, elo_a_post double"


def margin_multiplier(gd: Column) -> Column:
    """1 up to one goal, then 0.75 ln(gd + 1): a win by two counts less than a win by one."""
    return F.when(gd <= 1, 1.0).otherwise(F.log(gd + 1) * 0.75)


def expected_score(diff: Column, home: Column | float = 0.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -(diff + home) / 400))


def components(pairs: DataFrame) -> DataFrame:
    """(team, component) from pairs (home, away), by minimum labels over the distinct pairs."""
    shared_base(pairs.sparkSession)
    edges = pairs.select(F.least("home", "away").alias("a"), F.greatest("home", "away").alias("b")).distinct()
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    label = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).checkpoint()
    while True:
        near = edges.join(label.withColumnsRenamed({"a": "b", "c": "d"}), "b").groupBy("a").agg(F.min("d").alias("d"))
        new = label.join(near, "a").select("a", F.col("c").alias("old"), F.least("c", "d").alias("c"))
        new = new.join(label.select(F.col("a").alias("c"), F.col("c").alias("top")), "c").select("a", "old", F.least("c", "top").alias("c")).checkpoint()
        label = new.select("a", "c")
        if not new.where("old <> c").limit(1).count():
            return label.select(F.col("a").alias("team"), F.col("c").alias("component"))


def _replay(base: float, home_edge: float, digits: tuple[int, int] | None):
    """Replays batches of rows in order of (component, date, match_id); only the ratings of the component at hand are held."""

    def run(batches):
        component, rating = None, {}
        for b in batches:
            out = np.empty((len(b), 5))
            columns = [b.column(c).to_pylist() for c in ("component", "home", "away")] + [b.column(c).fill_null(math.nan).to_pylist() for c in ("score", "weight", "edge", "seed_h", "seed_a")]
            for i, (c, h, a, score, weight, edge, seed_h, seed_a) in enumerate(zip(*columns)):
                if c != component:
                    component, rating = c, {}
                eh = rating.get(h, base if math.isnan(seed_h) else seed_h)
                ea = rating.get(a, base if math.isnan(seed_a) else seed_a)
                exp = 1.0 / (1.0 + 10.0 ** ((ea - (eh + home_edge * edge)) / 400.0))
                step = weight * (score - exp)
                nh, na = eh + step, ea - step
                if digits:
                    nh, na = (math.floor(x * 10 ** digits[0] + 0.5) / 10 ** digits[0] for x in (nh, na))
                rating[h], rating[a] = nh, na
                out[i] = eh, ea, math.floor(exp * 10 ** digits[1] + 0.5) / 10 ** digits[1] if digits else exp, nh, na
            yield pa.RecordBatch.from_arrays([b.column("match_id").cast(pa.int64()), *[pa.array(out[:, k]) for k in range(5)]], ["match_id", "elo_h", "elo_a", "exp_h", "elo_h_post", "elo_a_post"])

    return run


def replay(m: DataFrame, weight: Column, score: Column | None = None, base: float = 1500.0, home_edge: float = 68.0, edge: Column | None = None, seeds: DataFrame | None = None, digits: tuple[int, int] | None = None) -> DataFrame:
    """Ratings before and after each played match of `m`.

    weight: K times the margin multiplier; score: 1, 0.5 or 0 for the home side unless given; edge: 1 where the home edge
    counts, 0 where not; seeds: (team, seed) starting ratings; digits: decimals of stored ratings, and of the
    expectation that is given out (the step takes it unrounded).
    """
    score = score if score is not None else F.when(F.col("hg") > F.col("ag"), 1.0).when(F.col("hg") == F.col("ag"), 0.5).otherwise(0.0)
    played = m.where("hg is not null and ag is not null")
    comp = components(played)
    rows = played.select("match_id", "date", "home", "away", score.cast("double").alias("score"), weight.cast("double").alias("weight"), (edge if edge is not None else F.lit(1.0)).cast("double").alias("edge"))
    if seeds is None:
        rows = rows.withColumns({"seed_h": F.lit(None).cast("double"), "seed_a": F.lit(None).cast("double")})
    else:
        rows = rows.join(seeds.withColumnsRenamed({"team": "home", "seed": "seed_h"}), "home", "left").join(seeds.withColumnsRenamed({"team": "away", "seed": "seed_a"}), "away", "left")
    rows = rows.join(comp.withColumnRenamed("team", "home"), "home").withColumns({"seed_h": F.coalesce("seed_h", F.lit(float("nan"))), "seed_a": F.coalesce("seed_a", F.lit(float("nan")))})
    return rows.repartition("component").sortWithinPartitions("component", F.asc_nulls_last("date"), F.asc_nulls_last("match_id")).mapInArrow(_replay(base, home_edge, digits), OUT)
