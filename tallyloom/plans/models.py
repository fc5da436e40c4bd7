"""Queries J and E20: models.  SQL can't train them; tests hold their invariants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import odds
from ..operators import boosting, form, grid, models, ratings
from ..operators.metrics import brier
from ..operators.strengths import monthly, rates
from ..sources.matches import matches, team_matches
from ..sources.storage import stored
from .expressions import bets
from .registry import query, rounded
from .windows import k_of_division, weight

ALL = models.BASE + models.SHOTS
CARDS = ["h_form5", "a_form5", "elo_diff"]


def frame(spark, d, m=None, cols=None):
    """Features of all matches; `m`: the matches, if they are stored already; `cols`: the columns asked for, others aren't computed."""
    m = stored(matches(spark, d)) if m is None else m
    rows = models.as_doubles(models.features(m, ratings.replay(m, weight(k_of_division()))), [*ALL, "hg", "ag", "cards"])
    return stored(rows if cols is None else rows.select(*cols))


@query("j1_logistic")
def logistic(spark, d):
    train, test = models.split(frame(spark, d))
    return rounded(models.evaluated(models.three(models.logistic(models.BASE).fit(train).transform(test)), "logistic"))


@query("j2_boosted")
def boosted(spark, d):
    """Softmax boosting: a tree a class and round."""
    train, test = models.split(frame(spark, d))
    return rounded(models.evaluated(boosting.predicted(boosting.fit(train, models.BASE), test), "boosted"))


@query("j3_over_classifier")
def over_classifier(spark, d):
    train, test = models.split(frame(spark, d))
    scored = models.boosted(models.BASE, "over", 2).fit(train).transform(test)
    p = F.get(models.vector_to_array("probability"), 1)
    return rounded(scored.agg(F.count("*").alias("n"), F.avg(((p > 0.5) == (F.col("over") == 1)).cast("int")).alias("accuracy"), brier(p, F.col("over")).alias("brier")))


def with_rates(train, test):
    for goal in ("hg", "ag"):
        scored = models.poisson(models.BASE, goal).fit(train).transform(test)
        test = scored.drop("raw", "features", *[f"_{c}" for c in models.BASE])
    clip = lambda c: F.greatest(F.least(F.col(c), F.lit(6.0)), F.lit(0.15))
    return test.withColumns({"lam": clip("rate_hg"), "mu": clip("rate_ag")})


@query("j4_goal_rates")
def goal_rates(spark, d):
    return rounded(with_rates(*models.split(frame(spark, d))).select("match_id", "lam", "mu"))


@query("j5_cards_ablation")
def cards_ablation(spark, d):
    m = stored(matches(spark, d))
    own = form.sides(team_matches(m), {"cards10": form.before("cards", 10)})
    rows = frame(spark, d, m).join(form.referee_form(m), "match_id").where("ref_n >= 5").join(own, "match_id")
    rows = stored(rows.select("date", "cards", *CARDS, "h_cards10", "a_cards10", "ref_avg"))  # each step of a fit reads it again
    train, test = models.split(rows)
    base = [*CARDS, "h_cards10", "a_cards10"]
    out = []
    for name, cols in (("without", base), ("with", [*base, "ref_avg"])):
        s = models.poisson(cols, "cards").fit(train).transform(test)
        out.append(s.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("rate_cards") - F.col("cards"))).alias("mae")).select(F.lit(name).alias("referee"), "*"))
    return rounded(out[0].unionByName(out[1]))


@query("j6_time_fold_search")
def time_fold_search(spark, d):
    rows = frame(spark, d, cols=["match_id", "date", "label", *models.BASE])
    found = models.tuned(rows, models.BASE, [0.001, 0.1], k=4)
    return rounded(found.groupBy("penalty").agg(F.count("*").alias("folds"), F.avg("logloss").alias("logloss")))


@query("j6_boosted_search")
def boosted_search(spark, d):
    """Boosted candidates drawn at random, judged on four time folds; the best comes first."""
    return rounded(models.search(frame(spark, d), models.BASE, boosting.drawn(4)))


@query("j7_strengths")
def strengths(spark, d):
    """The last matches of every division by the strengths of their month, which is fitted from what was before it."""
    _, test = models.split(matches(spark, d))
    months = test.select("div", F.trunc("date", "month").alias("month")).distinct()
    scored = rates(test.select("match_id", "div", "date", "home", "away"), monthly(matches(spark, d), months)).where("lam is not null")
    scored = scored.withColumn("grid", grid.cells(F.col("lam"), F.col("mu"), size=11))
    return rounded(scored.select("match_id", "lam", "mu", *[c.alias(k) for k, c in grid.outcome(F.col("grid")).items()]))


#: What is published is 0.8 parts boosted and 0.2 parts logistic.
ENGINE = boosting.Params(rounds=10, depth=3, rate=0.25)


def published(train, test, pool=0.95):
    """Each test match with everything that is published for it, read off one projected distribution; `pool` is the market's weight."""
    p = models.poisson(CARDS, "cards").fit(train).transform(with_rates(train, test)).drop("raw", "features", *[f"_{c}" for c in CARDS])
    p = models.three(models.logistic(models.BASE).fit(train).transform(p)).withColumnsRenamed({f"p{k}": f"q{k}" for k in range(3)})
    p = boosting.predicted(boosting.fit(train, models.BASE, ENGINE), p.drop("raw", "features", "rawPrediction", "probability", "prediction", *[f"_{c}" for c in models.BASE]))
    p = p.withColumns({f"p{k}": c for k, c in enumerate(odds.ensemble([F.col(f"p{k}") for k in range(3)], [F.col(f"q{k}") for k in range(3)]))})
    own = [F.col(f"p{k}") for k in range(3)]
    final = odds.pooled(odds.implied(*[F.col(c) for c in ("oh", "od", "oa")]), own, pool) if pool else own
    p = p.withColumns({k: c for k, c in zip(("ph", "pd", "pa"), final)})
    p = p.withColumn("grid", grid.projected(grid.cells(F.col("lam"), F.col("mu"), F.lit(-0.05)), {"h": F.col("ph"), "d": F.col("pd"), "a": F.col("pa")}))
    chance = {"1X": F.col("ph") + F.col("pd"), "12": F.col("ph") + F.col("pa"), "X2": F.col("pd") + F.col("pa")}
    p = p.withColumns({"over25": grid.over(F.col("grid")), "top": grid.likeliest(3), "double_chance": odds.first_max(chance), "confidence": F.greatest(*chance.values())})
    written = F.transform("top", lambda t: F.format_string("%d-%d", t["i"], t["j"]))
    listed = F.transform("top", lambda t: F.format_string("%d-%d %.3f", t["i"], t["j"], t["p"]))
    return p.withColumns({"score": F.get(written, 0), "scores": F.array_join(listed, ", ")})


@query("j8_batch_scoring")
def batch_scoring(spark, d):
    train, test = models.split(frame(spark, d))
    return rounded(published(train, test).select("match_id", "ph", "pd", "pa", "lam", "mu", F.col("rate_cards").alias("cards"), "over25", "score", "scores", "double_chance", "confidence"))


@query("j9_ablation")
def ablation(spark, d):
    return rounded(models.ablation(frame(spark, d), models.BASE, models.SHOTS))


@query("j9_windows_gate")
def windows_gate(spark, d):
    """Shots on target against the base features: the same configuration on five windows, and the verdict."""
    return rounded(models.gate(frame(spark, d), models.BASE, models.SHOTS))


@query("j10_odds_study")
def odds_study(spark, d):
    """Rating alone, model, market, model with market features, and pools of model and market by weight, on one split; `best` marks
    the weight of least log-loss, the first of equals."""
    rows = frame(spark, d)
    market = dict(zip(("kh", "kd", "ka"), odds.implied(*[F.col(c) for c in ("oh", "od", "oa")])))
    base = dict(zip(("eh", "ed", "ea"), odds.three_way(F.col("exp_h"), F.col("elo_diff"), 0.28, 300.0)))
    train, test = models.split(rows.withColumns(market).withColumns(base))
    test = stored(test)
    named = lambda cols: test.withColumns({f"p{k}": F.col(c) for k, c in enumerate(cols)})
    model = stored(models.three(models.logistic(models.BASE).fit(train).transform(test)).select(*test.columns, "p0", "p1", "p2"))
    both = models.three(models.logistic([*models.BASE, "kh", "kd", "ka"]).fit(train).transform(test))
    out = [models.evaluated(named(("eh", "ed", "ea")), "rating"), models.evaluated(model, "model"), models.evaluated(named(("kh", "kd", "ka")), "market"), models.evaluated(both, "model+market")]
    weights = F.explode(F.array(*[F.lit(k / 20) for k in range(21)]))
    pools = model.select("label", "kh", "kd", "ka", "p0", "p1", "p2", weights.alias("w"))
    mixed = [F.pow(F.col(c), F.col("w")) * F.pow(F.col(f"p{k}"), 1 - F.col("w")) for k, c in enumerate(("kh", "kd", "ka"))]
    pools = pools.select("label", "w", *[c.alias(f"m{k}") for k, c in enumerate(mixed)]).select("label", "w", *[(F.col(f"m{k}") / (F.col("m0") + F.col("m1") + F.col("m2"))).alias(f"p{k}") for k in range(3)])
    swept = models.evaluated_by(pools, "w").withColumn("best", F.row_number().over(W.orderBy("logloss", "w")) == 1)  # a row a weight
    swept = swept.select(F.format_string("pool %.2f", "w").alias("model"), "n", "accuracy", "logloss", "best")
    return rounded(reduce(lambda a, b: a.unionByName(b), out).withColumn("best", F.lit(None).cast("boolean")).unionByName(swept))


@query("j11_track_record")
def track_record(spark, d):
    """The last matches scored without the market, graded and summed up, with the value bets at opening prices."""
    train, test = models.split(frame(spark, d))
    p = published(train, test, pool=None)
    own = F.when(F.col("label") == 0, F.col("ph")).when(F.col("label") == 1, F.col("pd")).otherwise(F.col("pa"))
    pick = F.when((F.col("ph") >= F.col("pd")) & (F.col("ph") >= F.col("pa")), 0.0).when(F.col("pd") >= F.col("pa"), 1.0).otherwise(2.0)
    score = F.format_string("%d-%d", F.col("hg").cast("int"), F.col("ag").cast("int"))
    p = stored(p.withColumns({"own": own, "hit": (pick == F.col("label")).cast("int"), "was": score}).drop("grid", "top"))
    graded = p.agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg(-F.log(F.greatest(F.col("own"), F.lit(1e-9)))).alias("logloss"), F.avg((F.col("score") == F.col("was")).cast("int")).alias("exact"),
                   F.avg(((F.col("over25") > 0.5) == (F.col("over") == 1)).cast("int")).alias("over_accuracy"), brier(F.col("over25"), F.col("over")).alias("over_brier"), F.min("date").alias("first"), F.max("date").alias("last"))
    market = dict(zip(("kh", "kd", "ka"), odds.implied(*[F.col(c) for c in ("oh", "od", "oa")])))
    sides = p.select("match_id", "hg", "ag", *[F.col(f"p{o}").alias(f"m{o}") for o in "hda"], "oh", "od", "oa", "ch", "cd", "ca").withColumns(market)
    staked = bets(sides).agg(F.count("*").alias("bets"), F.avg("roi").alias("roi"), F.avg((F.col("clv") > 0).cast("int")).alias("beat_close"), F.avg("clv").alias("clv"))
    return rounded(graded.join(staked, how="cross"))  # one row each


def importances(spark, d):
    train, _ = models.split(frame(spark, d))
    model = models.boosted(ALL, "over", 2).fit(train).stages[-1]
    return spark.createDataFrame([(c, float(v)) for c, v in zip(ALL, model.featureImportances.toArray())], "feature string, gain double")  # a row a feature


@query("j12_importances")
def gain_by_prefix(spark, d):
    return rounded(importances(spark, d).groupBy(F.regexp_extract("feature", "^[a-z]+", 0).alias("prefix")).agg(F.sum("gain").alias("gain"), F.count("*").alias("features")))


@query("e20_importance_ranks")
def importance_ranks(spark, d):
    return rounded(importances(spark, d).withColumn("place", F.rank().over(W.orderBy(F.desc("gain")))))
