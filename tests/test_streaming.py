"""Streams: state that merges, is replayed and is let go of."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ratings
from tallyloom.streaming import flows
from tallyloom.streaming.rating_state import MATCH, RatingState

DAY = dt.date(2020, 1, 1)


def rows(spec):
    return [(k, DAY + dt.timedelta(days=day), h, a, s, 20.0 + k % 3) for k, day, h, a, s in spec]


def batch_replay(spark, spec):
    m = spark.createDataFrame(rows(spec), MATCH).withColumns({"hg": F.lit(1), "ag": F.lit(0)})
    return {r["match_id"]: (r["elo_h"], r["elo_a"]) for r in ratings.replay(m, F.col("weight"), F.col("score")).collect()}


def streamed(spark, tmp_path, batches, every=16):
    state = RatingState(spark, str(tmp_path), every=every)
    for epoch, spec in enumerate(batches):
        state.refresh(spark.createDataFrame(rows(spec), MATCH), epoch)
        if epoch == 1:  # a batch that is run again leaves the same
            state.refresh(spark.createDataFrame(rows(spec), MATCH), epoch)
    return state, {r["match_id"]: (r["elo_h"], r["elo_a"]) for r in state.ratings().collect()}


def test_a_promotion_and_a_late_match_equal_the_batch_replay(spark, tmp_path):
    first = [(1, 0, 1, 2, 1.0), (2, 1, 2, 3, 0.5), (3, 0, 11, 12, 0.0), (4, 2, 12, 13, 1.0), (5, 3, 21, 22, 1.0)]
    second = [(6, 5, 3, 11, 1.0), (7, 6, 1, 2, 0.0)]  # joins two components
    third = [(8, 4, 13, 12, 1.0), (9, 8, 1, 13, 0.5)]  # match 8 is late in the joined one
    fourth = [(10, 9, 21, 22, 0.0), (2, 1, 2, 3, 0.5)]  # one component goes on; a match is delivered again
    state, got = streamed(spark, tmp_path, [first, second, third, fourth])
    want = batch_replay(spark, first + second + third + fourth[:1])
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    teams = {r["team"]: r["component"] for r in state.teams(4).collect()}
    assert {teams[t] for t in (1, 2, 3, 11, 12, 13)} == {1} and {teams[t] for t in (21, 22)} == {21}
    touched = {r["component"] for r in spark.read.parquet(f"{tmp_path}/teams/epoch=1").select("component").distinct().collect()}
    assert touched == {1}  # the third component was left alone


def test_random_arrivals_and_snapshots(spark, tmp_path):
    rng = random.Random(5)
    spec = [(k, rng.randrange(60), *rng.sample([1, 2, 3, 4, 11, 12, 13, 14] if k % 9 == 0 else [1, 2, 3, 4] if k % 2 else [11, 12, 13, 14], 2), rng.choice([0.0, 0.5, 1.0])) for k in range(60)]
    order = sorted(spec, key=lambda r: r[1] + (30 if rng.random() < 0.1 else 0))
    _, got = streamed(spark, tmp_path, [order[k : k + 15] for k in range(0, 60, 15)], every=2)
    want = batch_replay(spark, spec)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def sides(spark, pairs, name):
    return spark.createDataFrame([(k, 1, 2 + k % 2, dt.datetime(2020, 1, 1) + dt.timedelta(days=d)) for k, d in pairs], f"{name}id long, home long, away long, {name}_ts timestamp")


def test_expiry_comes_out_of_the_stream_and_leaves_no_state(spark):
    p, r = sides(spark, [(2, 0), (4, 30), (6, 60), (8, 88), (10, 100)], "p"), sides(spark, [(20, 2), (22, 34), (24, 58), (26, 102)], "r")
    progress = []
    out = flows.drained(flows.settled(flows.source(spark, p, order="p_ts", end="p_ts", marker={"home": -1, "away": -1}), flows.source(spark, r, order="r_ts", end="r_ts", marker={"home": -2, "away": -2}), expiry=14.5).select("pid", "rid"), progress=progress)
    got = {(x["pid"], x["rid"]) for x in out.where("pid is not null").collect()}
    assert got == {(2, 20), (4, None), (6, 24), (8, None), (10, 26)}
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 2  # the two markers

    open_ = flows.drained(flows.settled(flows.source(spark, p, order="p_ts"), flows.source(spark, r, order="r_ts"), expiry=14.5).select("pid", "rid"))
    assert {(x["pid"], x["rid"]) for x in open_.collect()} == {(2, 20), (4, None), (6, 24), (10, 26)}  # 8 is pending: 102 - 88 is 14 days


def test_windows_are_written_once_and_let_go(spark):
    begin = dt.datetime(2020, 1, 1)
    events = spark.createDataFrame([(begin + dt.timedelta(hours=5 * k), k % 3) for k in range(200)], "ts timestamp, user_id int")
    progress = []
    out = flows.drained(flows.distinct_in_windows(flows.source(spark, events, order="ts", end="ts"), "2 days", "1 day", "user_id"), progress=progress)
    got = {(r["w"]["start"], r["n"], r["items"]) for r in out.where("items > 0").collect()}
    want = {}
    for ts, user in ((begin + dt.timedelta(hours=5 * k), k % 3) for k in range(200)):
        for back in (0, 1):
            want.setdefault(dt.datetime(ts.year, ts.month, ts.day) - dt.timedelta(days=back), []).append(user)
    assert got == {(w, len(u), len(set(u))) for w, u in want.items()}
    assert all(s["numRowsTotal"] <= 4 for s in progress[-1]["stateOperators"])


def test_keys_are_new_once(spark):
    rows_ = [(k % 7, dt.datetime(2020, 1, 1) + dt.timedelta(days=k % 7)) for k in range(60)]
    s = spark.createDataFrame(rows_, "k int, ts timestamp")
    out = flows.drained(flows.new_keys(flows.source(spark, s, order="ts"), ["k", "ts"], "ts", "1 day", s.where("k < 2")))
    assert sorted(r["k"] for r in out.collect()) == [2, 3, 4, 5, 6]


def test_upserts_merge_as_deltas(spark):
    rows_ = spark.createDataFrame([(k % 10, k) for k in range(400)], "k int, v long")
    merge = lambda df: df.groupBy("k").agg(F.max("v").alias("v"))
    source = flows.source(spark, rows_, files=3)
    written = []

    def batch(df, epoch, out):
        flows.upserts(lambda x: merge(x.withColumnRenamed("v", "v")).withColumnRenamed("v", "best"))(df, epoch, out)
        written.append(spark.read.parquet(f"{out}/v={epoch}").count())

    out = flows.drained(source, batch=batch)
    assert len(written) == 3 and max(written) <= 10
    assert {(r["k"], r["b"]) for r in out.groupBy("k").agg(F.max("best").alias("b")).collect()} == {(k, 390 + k) for k in range(10)}


@pytest.mark.parametrize("expiry", [None, 14.5])
def test_rows_meet_by_bins_of_time_and_lose_no_pair(spark, expiry):
    rng = random.Random(3)
    days = {k: rng.randrange(300) for k in range(2, 200)}
    p, r = sides(spark, [(k, d) for k, d in days.items() if k % 3 == 0], "p"), sides(spark, [(k, d) for k, d in days.items() if k % 3], "r")
    out = flows.settled(flows.source(spark, p, order="p_ts"), flows.source(spark, r, order="r_ts"), expiry=expiry)
    assert re.search(r"bin#\d+L? = bin#\d+", out._jdf.queryExecution().analyzed().toString()) and "bin" not in out.columns
    got = [(x["pid"], x["rid"]) for x in flows.drained(out.select("pid", "rid")).collect() if x["rid"] is not None]
    want = [(a, b) for a in days for b in days if a % 3 == 0 and b % 3 and a % 2 == b % 2 and abs(days[a] - days[b]) <= 3]
    assert len(want) > 50 and sorted(got) == sorted(want)
