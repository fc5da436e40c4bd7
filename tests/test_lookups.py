"""Periods that overlap and nest, names that sources write differently, and keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import names
from tallyloom.operators import settle

DAY = dt.date(2020, 1, 1)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_periods_that_overlap_and_nest(spark, seed):
    rng = random.Random(seed)
    periods = [(k % 3, DAY + dt.timedelta(days=a), DAY + dt.timedelta(days=a + rng.choice([0, 3, 10, 60, -2])), k) for k, a in enumerate(rng.sample(range(100), 40))]
    asked = [(q, rng.randrange(4), DAY + dt.timedelta(days=rng.randrange(-5, 180))) for q in range(300)]
    want = {}
    for q, key, day in asked:
        own = [p for p in periods if p[0] == key]
        cover = [p for p in own if p[1] <= day <= p[2]]
        best = max(cover, key=lambda p: p[1]) if cover else max(own, key=lambda p: (p[1], p[2]), default=(None,) * 4)
        want[q] = (best[3], bool(cover))
    got = settle.valid_at(spark.createDataFrame(asked, "qid long, k int, day date").repartition(5), spark.createDataFrame(periods, "k int, start date, finish date, value long").repartition(3), "k")
    assert {r["qid"]: (r["value"], r["exact"]) for r in got.collect()} == want


def test_no_periods_and_no_questions(spark):
    asked, periods = spark.createDataFrame([(1, 1, DAY)], "qid long, k int, day date"), spark.createDataFrame([], "k int, start date, finish date, value long")
    assert [(r["value"], r["exact"]) for r in settle.valid_at(asked, periods, "k").collect()] == [(None, False)]
    assert settle.valid_at(asked.limit(0), periods, "k").count() == 0


def test_tokens_aliases_and_expansions(spark):
    cases = [("Nott'm Forest", ["forest", "nottingham"]), ("QPR", ["park", "queens", "rangers"]), ("Man Utd", ["manchester", "united"]), ("FC Köln 1", ["koln"]), ("M'gladbach", ["borussia", "monchengladbach"]), ("Paris SG", ["germain", "paris", "saint"]), ("Spurs", ["tottenham"])]
    rows = spark.createDataFrame(cases, "name string, want array<string>").select(names.token_set(names.aliased(F.col("name"))).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in rows)


def test_keys_fold_before_they_are_split(spark):
    cases = [("Bodø/Glimt FK", ["bodo", "glimt", "fk"]), ("Saint\u2010Étienne", ["saintetienne"]), ("A\u00a0B-C", ["ab", "c"]), ("\u00bd x", ["12", "x"]), ("ǅ æ", ["dz", "ae"])]
    rows = spark.createDataFrame(cases, "name string, want array<string>").select(names.tokens(F.col("name")).alias("got"), "want").collect()
    assert [r["got"] for r in rows][:3] == [r["want"] for r in rows][:3] and rows[4]["got"] == rows[4]["want"]
