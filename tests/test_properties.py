"""Properties: nothing leaks from later rows, input order does not matter, boundaries are as documented."""

import datetime as dt

from pyspark.sql import functions as F

from tallyloom.operators import form, ratings, settle
from tallyloom.sources.matches import team_matches

SCHEMA = "match_id long, date date, div int, home long, away long, hg int, ag int, hst int, ast int, cards int"


def season(spark, n=60):
    day = dt.date(2020, 1, 1)
    rows = [(k, day + dt.timedelta(days=k // 2), 0, k % 5, (k + 1 + k % 3) % 5, k % 4, k % 3, None if k % 6 == 0 else k % 7, k % 5, k % 6) for k in range(n) if k % 5 != (k + 1 + k % 3) % 5]
    return spark.createDataFrame(rows, SCHEMA)


def test_form_does_not_leak(spark):
    m = season(spark)
    whole = {(r["team"], r["match_id"]): r for r in form.rolling_form(team_matches(m)).collect()}
    early = form.rolling_form(team_matches(m.where("match_id < 30"))).collect()
    assert early and all(whole[r["team"], r["match_id"]] == r for r in early)


def test_first_match_has_the_priors(spark):
    first = form.rolling_form(team_matches(season(spark).where("match_id = 0"))).first()
    assert (first["gf5"], first["ga10"], first["form5"]) == (1.3, 1.3, 0.5)


def test_replay_ignores_input_order_and_splits_by_component(spark):
    m = season(spark)
    other = m.select((F.col("match_id") + 1000).alias("match_id"), "date", "div", (F.col("home") + 50).alias("home"), (F.col("away") + 50).alias("away"), "hg", "ag", "hst", "ast", "cards")
    weight = 20 * ratings.margin_multiplier(F.abs(F.col("hg") - F.col("ag")))
    both = {r["match_id"]: r[1:] for r in ratings.replay(m.union(other).orderBy(F.rand(1)), weight).collect()}
    alone = {r["match_id"]: r[1:] for r in ratings.replay(m, weight).collect()}
    assert all(both[k] == v and both[k + 1000] == v for k, v in alone.items())


def test_head_to_head_is_seen_from_the_smaller_key(spark):
    m = spark.createDataFrame([(1, dt.date(2020, 1, 1), 2, 1, 3, 0), (2, dt.date(2020, 1, 2), 1, 2, 0, 0), (3, dt.date(2020, 1, 3), 2, 1, 0, 0)], "match_id long, date date, home long, away long, hg int, ag int")
    assert [r["h2h"] for r in form.head_to_head(m).orderBy("match_id").collect()] == [0.5, 0.0, 0.25]
    assert [r["h2h"] for r in form.head_to_head(m, home_view=True).orderBy("match_id").collect()] == [0.5, 0.0, 0.75]


def test_as_of_is_strictly_before(spark):
    e = spark.createDataFrame([("a", 1, 10), ("a", 2, 11), ("a", 3, 12)], "k string, t int, id int")
    v = spark.createDataFrame([("a", 2, 5.0, 1), ("a", 2, 7.0, 2)], "k string, t int, v double, ord int")
    got = {r["id"]: r["v_before"] for r in settle.as_of(e, v, "k", "t", "v").collect()}
    assert got == {10: None, 11: None, 12: 7.0}


def test_settlement_window(spark):
    day = dt.date(2020, 1, 10)
    pending = spark.createDataFrame([(1, 0, 1, 2, day)], "pid long, div int, home long, away long, date date")
    for off, hit in ((-4, False), (-3, True), (0, True), (3, True), (4, False)):
        results = spark.createDataFrame([(9, 0, 1, 2, day + dt.timedelta(days=off), 1, 0)], "match_id long, div int, home long, away long, date date, hg int, ag int")
        assert bool(settle.settle_within(pending, results).collect()) == hit


def test_transfer_out_and_back(spark):
    moves = spark.createDataFrame([("p", "A", 10.0, 1, 1), ("p", "B", 12.0, 2, 2), ("p", "A", 15.0, 3, 3)], "member string, grp string, value double, ts int, id int")
    got = [(r["grp"], r["ts"], r["total"]) for r in form.group_totals(moves).orderBy("grp", "ts").collect()]
    assert got == [("A", 1, 10.0), ("A", 2, 0.0), ("A", 3, 15.0), ("B", 2, 12.0), ("B", 3, 0.0)]
    spans = [(r["grp"], r["ts"], r["total"]) for r in form.group_totals(moves, F.expr("nullif(ts div 2, 0)")).orderBy("grp", "ts").collect()]
    assert spans == got
