"""Every query without a SQL twin outside the corpus subpackage holds its invariants on the smallest tables."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyloom.operators import form, metrics

DATA = "/root/testdata/sf0.001"


def rows(spark, name):
    return entry.queries()[name](spark, DATA).collect()


@pytest.mark.parametrize("name", ["j1_logistic", "j2_boosted"])
def test_outcome_models_beat_even_chances(spark, name):
    (r,) = rows(spark, name)
    assert r["n"] > 200 and 0 < r["accuracy"] < 1 and r["logloss"] < math.log(3)


def test_over_classifier_and_importances(spark):
    (r,) = rows(spark, "j3_over_classifier")
    assert 0.5 < r["accuracy"] <= 1 and r["brier"] < 0.25
    ranks = rows(spark, "e20_importance_ranks")
    assert sum(x["gain"] for x in ranks) == pytest.approx(1, abs=1e-4)
    assert [x["place"] for x in sorted(ranks, key=lambda x: -x["gain"])] == sorted(x["place"] for x in ranks)
    shares = rows(spark, "j12_importances")
    assert sum(x["gain"] for x in shares) == pytest.approx(1, abs=1e-4) and sum(x["features"] for x in shares) == len(ranks)


def test_rates_and_strengths(spark):
    assert all(0.15 <= r["lam"] <= 6 and 0.15 <= r["mu"] <= 6 for r in rows(spark, "j4_goal_rates"))
    by_strength = rows(spark, "j7_strengths")
    assert all(r["h"] + r["d"] + r["a"] == pytest.approx(1, abs=1e-5) for r in by_strength)
    tested = entry.queries()["j8_batch_scoring"](spark, DATA).select("match_id").collect()
    assert len(by_strength) >= 0.9 * len(tested)


def test_cards_with_and_without_referees(spark):
    got = {r["referee"]: r for r in rows(spark, "j5_cards_ablation")}
    assert got.keys() == {"with", "without"} and got["with"]["n"] == got["without"]["n"] and all(0 < r["mae"] < 3 for r in got.values())


def test_odds_study_marks_the_best_pool(spark):
    got = {r["model"]: r for r in rows(spark, "j10_odds_study")}
    pools = [r for name, r in got.items() if name.startswith("pool")]
    assert len(pools) == 21 and sum(r["best"] for r in pools) == 1
    best = next(r for r in pools if r["best"])
    assert best["logloss"] == min(r["logloss"] for r in pools)
    assert got["pool 0.00"]["logloss"] == pytest.approx(got["model"]["logloss"], abs=1e-5) and got["pool 1.00"]["logloss"] == pytest.approx(got["market"]["logloss"], abs=1e-5)


def test_record_has_bets(spark):
    (r,) = rows(spark, "j11_track_record")
    assert r["bets"] > 0 and -1 <= r["roi"] and 0 <= r["beat_close"] <= 1 and r["first"] <= r["last"]


def test_bootstraps(spark):
    d = spark.range(400).select(F.col("id"), (F.col("id") % 7 / 7.0).alias("a"), (F.col("id") % 7 / 7.0 + 0.01 * (F.col("id") % 3)).alias("b"))
    reps = [r["mean"] for r in metrics.bootstrap(d, "id", F.col("a"), 40).collect()]
    assert len(reps) == 40 and abs(sum(reps) / 40 - 3 / 7) < 0.02 and 0 < max(reps) - min(reps) < 0.2
    r = metrics.paired_bootstrap(d, "id", F.col("a"), F.col("b")).first()
    assert r["p_better"] == 1 and r["low"] < r["mean"] < r["high"] < 0 and r["mean"] == pytest.approx(-0.01, abs=1e-3)
    same = metrics.paired_bootstrap(d, "id", F.col("a"), F.col("a")).first()
    assert (same["mean"], same["low"], same["high"], same["p_better"]) == (0, 0, 0, 0)


def test_referee_form_does_not_depend_on_chunks(spark):
    m = spark.range(900).select(F.col("id").alias("match_id"), F.expr("date_add(date '2020-01-01', cast(id div 3 as int))").alias("date"), F.when(F.col("id") % 10 > 0, F.col("id") % 2).alias("referee"), (F.col("id") % 5).cast("int").alias("cards"))
    whole = {r["match_id"]: (r["ref_avg"], r["ref_n"]) for r in form.referee_form(m, 40).collect()}
    small = {r["match_id"]: (r["ref_avg"], r["ref_n"]) for r in form.referee_form(m, 40, chunk=50).collect()}
    assert whole == small and len(whole) == 900
