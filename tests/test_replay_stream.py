"""Rating replay in batches: no task holds a component."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tallyloom.operators import ratings


def plain(rows):
    rating, out = {}, {}
    for k, day, h, a, hg, ag in sorted(rows, key=lambda r: (r[1], r[0])):
        eh, ea = rating.get(h, 1500.0), rating.get(a, 1500.0)
        step = 20 * ((1.0 if hg > ag else 0.5 if hg == ag else 0.0) - 1 / (1 + 10 ** ((ea - (eh + 68)) / 400)))
        rating[h], rating[a] = eh + step, ea - step
        out[k] = eh, ea
    return out


def test_components_stream_through_batches_and_start_anew(spark):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        league = rng.randrange(5)
        h, a = rng.sample(range(4), 2)
        rows.append((k, dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(40)), league * 10 + h, league * 10 + a, rng.randrange(4), rng.randrange(4)))
    m = spark.createDataFrame(rows, "match_id long, date date, home long, away long, hg int, ag int").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        rated = ratings.replay(m, F.lit(20))
        got = {r["match_id"]: (r["elo_h"], r["elo_a"]) for r in rated.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == plain(rows)
    plan = rated._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
