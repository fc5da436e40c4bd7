"""Features of both sides of a match, against a join for each side."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tallyloom.operators import form, models
from tallyloom.sources.matches import team_matches

SCHEMA = "match_id long, date date, div int, home long, away long, hg int, ag int, hst int, ast int, cards int, referee long, oh double, od double, oa double, ch double, cd double, ca double"


def test_sides_equal_a_join_for_each_and_need_one_sort_of_teams(spark):
    rng = random.Random(6)
    rows = []
    for k in range(200):
        h, a = rng.sample(range(6), 2)
        goals = (rng.randrange(4), rng.randrange(4)) if k % 9 else (None, None)  # some matches are not played
        rows.append((k, dt.date(2021, 1, 1) + dt.timedelta(days=rng.randrange(90)), 1, h, a if k % 50 else None, *goals, rng.choice([None, 3, 5]), rng.choice([None, 2, 4]), rng.randrange(6), None, *[2.0] * 6))
    m = spark.createDataFrame(rows, SCHEMA)
    tm = team_matches(m)
    own = form.rolling_form(tm).join(form.rest_days(tm), ["team", "match_id"]).join(form.shots_form(tm).select("team", "match_id", F.col("sot_for").alias("sot")), ["team", "match_id"])
    joined = m.select("match_id", "home", "away")
    for side, p in (("home", "h"), ("away", "a")):
        joined = joined.join(own.select(F.col("team").alias(side), "match_id", *[F.col(c).alias(f"{p}_{c}" if c != "rest" else f"rest_{p}") for c in ("gf5", "ga5", "form5", "rest", "sot")]), [side, "match_id"])
    names = ["match_id", *[f"{p}_{c}" for p in "ha" for c in ("gf5", "ga5", "form5", "sot")], "rest_h", "rest_a"]
    rated = m.select("match_id", F.lit(1.0).alias("elo_h"), F.lit(2.0).alias("elo_a"), F.lit(0.5).alias("exp_h"))
    got = models.features(m, rated)
    key = lambda df: sorted(map(tuple, df.select(*names).collect()))
    assert key(got) == key(joined) and 100 < got.count() < 200
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 2  # one over teams, one over pairs
