"""Softmax boosting, its search, monthly strengths and engine snapshots on planted tables."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import boosting, models
from tallyloom.operators.boosting import Params
from tallyloom.operators.snapshot import Snapshots
from tallyloom.operators.strengths import FITTED, monthly, rates

FEATURES = ["a", "b", "c", "noise"]


@pytest.fixture(scope="module")
def planted(spark):
    """Labels follow a and the product of b and c; in the last of five blocks of time they are pure chance."""
    rng = np.random.default_rng(1)
    n = 3000
    x = rng.normal(size=(n, 4))
    score = 1.5 * np.stack([2 * (x[:, 0] > 0.3), np.zeros(n), 2 * (x[:, 1] > 0) * (x[:, 2] < 0.5)], 1)
    p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
    y = [int(rng.choice(3, p=q)) for q in p]
    rows = [(k, dt.date(2000, 1, 1) + dt.timedelta(days=k), y[k], *map(float, x[k])) for k in range(n)]
    truth = float(-np.log(p[np.arange(n), y]).mean())
    return spark.createDataFrame(rows, "match_id long, date date, label int, a double, b double, c double, noise double").repartition(4).cache(), truth


def test_loss_falls_with_rounds_and_nears_the_truth(planted):
    rows, truth = planted
    model = boosting.fit(rows, FEATURES, Params(rounds=12, rate=0.2))
    losses = [c[1] / c[0] for c in model.curve]
    assert len(losses) == 13 and losses[0] == pytest.approx(np.log(3)) and all(b < a for a, b in zip(losses, losses[1:]))
    assert losses[-1] < truth + 0.03
    assert model.gains[3] < 0.03 * model.gains.sum()
    scored = boosting.predicted(model, rows).selectExpr("avg(-ln(case label when 0 then p0 when 1 then p1 else p2 end)) as loss", "max(abs(p0 + p1 + p2 - 1)) as off").first()
    assert scored["loss"] == pytest.approx(losses[-1]) and scored["off"] < 1e-12


def test_missing_values_and_empty_tables(spark, planted):
    rows, _ = planted
    holes = rows.withColumn("a", F.when(F.col("match_id") % 5 > 0, F.col("a"))).withColumn("noise", F.lit(None).cast("double"))
    model = boosting.fit(holes, FEATURES, Params(rounds=2, depth=2))
    assert boosting.predicted(model, holes).where("p0 is null or p0 <= 0").count() == 0
    assert boosting.predicted(model, holes.limit(0)).count() == 0


def test_folds_learn_from_earlier_blocks_alone(planted):
    rows, _ = planted
    cut = models.blocked(rows, 4)
    sizes = {r["block"]: (r["n"], r["low"], r["high"]) for r in cut.groupBy("block").agg(F.count("*").alias("n"), F.min("date").alias("low"), F.max("date").alias("high")).collect()}
    assert {k: v[0] for k, v in sizes.items()} == {k: 600 for k in range(5)} and all(sizes[k][2] < sizes[k + 1][1] for k in range(4))
    edges = boosting.cut_points(rows, FEATURES)
    base = boosting.packed(cut, FEATURES, edges, block="block")
    odd = boosting.packed(cut.withColumn("label", F.when(F.col("block") >= 3, 2 - F.col("label")).otherwise(F.col("label"))), FEATURES, edges, block="block")
    a, b = (boosting.fit_many(t, FEATURES, edges, [Params(rounds=2, depth=2, fold=3)])[0] for t in (base, odd))
    assert a.curve[-1][0] == 1800 and a.curve[-1][2] == 600
    assert all(np.allclose(x[2], y[2]) for s, t in zip(a.trees, b.trees) for x, y in zip(s, t))


def test_search_returns_the_best_first(planted):
    rows, _ = planted
    candidates = [Params(rounds=1, depth=1, rate=0.01), Params(rounds=8, depth=3, rate=0.3)]
    found = models.search(rows, FEATURES, candidates).collect()
    assert [r["best"] for r in found] == [True, False] and found[0]["rounds"] == 8 and found[0]["logloss"] < found[1]["logloss"]
    assert all(r["folds"] == 4 for r in found)


def test_a_gate_adopts_what_helps_in_the_windows(planted):
    rows, _ = planted
    helps = models.gate(rows, ["noise"], ["a"], params=Params(rounds=3, depth=2, rate=0.3)).collect()
    assert len(helps) == 5 and all(r["verdict"] == "adopt" and r["delta"] < 0 for r in helps)
    assert models.gate(rows, ["a"], ["noise"], params=Params(rounds=3, depth=2, rate=0.3)).first()["verdict"] == "reject"


def league(spark, seed=2, matches=2500):
    rng = random.Random(seed)
    attack, defence = [0.5, 0.2, 0.0, -0.2, -0.5], [-0.3, 0.1, 0.0, -0.1, 0.3]
    gen = np.random.default_rng(seed)
    rows = []
    for k in range(matches):
        h, a = rng.sample(range(5), 2)
        rows.append((k, dt.date(2019, 1, 1) + dt.timedelta(days=k // 4), 1, h, a, int(gen.poisson(np.exp(0.2 + 0.25 + attack[h] + defence[a]))), int(gen.poisson(np.exp(0.2 + attack[a] + defence[h])))))
    return spark.createDataFrame(rows, "match_id long, date date, div int, home long, away long, hg int, ag int"), attack, defence


def test_strengths_are_recovered_and_see_nothing_of_their_month(spark):
    m, attack, defence = league(spark)
    months = spark.createDataFrame([(1, dt.date(2020, 6, 1)), (1, dt.date(2020, 9, 1)), (1, dt.date(2018, 1, 1)), (9, dt.date(2020, 6, 1))], "div int, month date")
    got = monthly(m, months, half_life=1e6, alpha=1e-4)
    assert got.columns == [c.split()[0] for c in FITTED.split(", ")]
    rows = {r["team"]: r for r in got.where("month = '2020-09-01'").collect()}
    assert len(rows) == 5 and rows[0]["home"] == pytest.approx(0.25, abs=0.06)
    for t in range(5):
        assert rows[t]["attack"] - rows[2]["attack"] == pytest.approx(attack[t] - attack[2], abs=0.12)
        assert rows[t]["defence"] - rows[2]["defence"] == pytest.approx(defence[t] - defence[2], abs=0.12)
    assert {(r["div"], str(r["month"])) for r in got.select("div", "month").distinct().collect()} == {(1, "2020-06-01"), (1, "2020-09-01")}
    later = m.withColumn("hg", F.when(F.col("date") >= "2020-06-01", 9).otherwise(F.col("hg")))
    key = lambda df: sorted((r["team"], round(r["attack"], 9), round(r["base"], 9)) for r in df.where("month = '2020-06-01'").collect())
    assert key(monthly(later, months)) == key(monthly(m, months))


def test_a_fit_equals_one_over_all_its_matches(spark):
    from tallyloom.operators.strengths import newton

    m, *_ = league(spark, matches=300)
    got = {r["team"]: r for r in monthly(m, spark.createDataFrame([(1, dt.date(2019, 3, 1))], "div int, month date")).collect()}
    rows = [r for r in m.collect() if r["date"] < dt.date(2019, 3, 1)]
    w = np.array([2 ** (-(dt.date(2019, 3, 1) - r["date"]).days / 180) for r in rows])
    long_ = [(r["home"], r["away"], 1.0, r["hg"]) for r in rows] + [(r["away"], r["home"], 0.0, r["ag"]) for r in rows]
    a, d, h, g = (np.array(c) for c in zip(*long_))
    beta = newton(a, d, h, np.r_[w, w], np.r_[w, w] * g, 5, 0.008)
    assert [got[t]["attack"] for t in range(5)] == pytest.approx(list(beta[:5]), abs=1e-6) and got[0]["base"] == pytest.approx(beta[-1], abs=1e-6)


def test_unseen_teams_and_divisions(spark):
    m, *_ = league(spark, matches=300)
    fitted = monthly(m, spark.createDataFrame([(1, dt.date(2019, 3, 1))], "div int, month date"))
    asked = spark.createDataFrame([(1, 1, dt.date(2019, 3, 5), 0, 77), (2, 5, dt.date(2019, 3, 5), 0, 1)], "match_id long, div int, date date, home long, away long")
    got = {r["match_id"]: r for r in rates(asked, fitted).collect()}
    assert 0.1 <= got[1]["lam"] <= 6 and got[2]["lam"] is None


def test_scores_are_equal_after_a_reload(spark, planted, tmp_path):
    rows, _ = planted
    train = models.as_doubles(rows, ["label"])
    model = models.logistic(FEATURES).fit(train)
    snaps = Snapshots(spark, str(tmp_path / "engine"))
    with pytest.raises(FileNotFoundError):
        snaps.table("state")
    assert snaps.publish({"state": rows.select("match_id")}, {"outcome": model}) == 1
    assert snaps.publish({"state": rows.where("match_id < 10").select("match_id")}, {"outcome": model}) == 2
    rows.limit(3).write.parquet(str(tmp_path / "engine/version=3/tables/state"))  # cut short before its commit
    assert snaps.versions() == [1, 2] and snaps.table("state").count() == 10 and snaps.table("state", 1).count() == 3000
    both = models.three(model.transform(train)).select("match_id", F.col("p0").alias("x")).join(models.three(snaps.pipeline("outcome").transform(train)).select("match_id", F.col("p0").alias("y")), "match_id")
    assert both.where("x <> y").count() == 0 and both.count() == 3000


def test_chunks_hold_each_row_once_in_order_of_blocks_and_trees_are_walked_alike():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    n, width = 2 * boosting.CHUNK + 77, 3
    x, label, block = rng.integers(0, 32, (n, width)).astype(np.uint8), rng.integers(0, 3, n), rng.integers(0, 5, n)
    whole = pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(block, pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "block", "x"])
    chunks = list(boosting._chunks((whole.slice(k, 1000) for k in range(0, n, 1000)), width))
    assert 2 <= len(chunks) <= 3 and all((np.diff(b) >= 0).all() and c.shape == (width, len(b)) for c, _, b in chunks)
    rows = lambda x, label, block: sorted(zip(*map(list, x.T), label, block))
    assert sorted(r for c, l, b in chunks for r in rows(c.T, l, b)) == rows(x, label, block)
    for depth in (1, 2, 4):
        split, at = rng.integers(0, width, 2**depth - 1), rng.integers(0, 33, 2**depth - 1)
        got = boosting._leaves(np.ascontiguousarray(x.T), (split, at, None))
        for r, leaf in list(zip(x, got))[:500]:
            node = 0
            for _ in range(depth):
                node = 2 * node + 1 + int(r[split[node]] > at[node])
            assert leaf == node - len(split)


def test_a_search_makes_no_pass_for_models_that_have_ended(planted, monkeypatch):
    rows, _ = planted
    edges = boosting.cut_points(rows, FEATURES)
    table = boosting.packed(models.blocked(rows, 4), FEATURES, edges, block="block")
    passes, real = [], boosting._pass
    monkeypatch.setattr(boosting, "_pass", lambda t, m, growing, n, level: passes.append(len(growing)) or real(t, m, growing, n, level))
    both = boosting.fit_many(table, FEATURES, edges, [Params(rounds=1, depth=3, fold=4), Params(rounds=2, depth=1, fold=4)])
    assert passes == [2, 1, 1, 2, 1] and [len(m.trees) for m in both] == [1, 2]
