"""Trainable models as Spark ML pipelines, and their evaluation on time-ordered splits."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, form, ratings
from ..sources.matches import team_matches
from ..sources.storage import stored

BASE = ["elo_diff", "exp_h", "rest_h", "rest_a", "h_gf5", "h_ga5", "a_gf5", "a_ga5", "h_form5", "a_form5", "h2h"]
SHOTS = ["h_sot", "a_sot"]


def features(m: DataFrame, rated: DataFrame) -> DataFrame:
    """One row a match: what was known before it, with label (0 home, 1 draw, 2 away) and goals."""
    tm = team_matches(m)
    sides = form.sides(tm, {"gf5": form.before("gf", 5, prior=1.3), "ga5": form.before("ga", 5, prior=1.3), "form5": form.before(F.col("pts") / 3, 5, prior=0.5), "rest": form.rest(), "sot": form.before(F.coalesce("sf", "gf"), 10, prior=4.4)})
    sides = sides.withColumnsRenamed({"h_rest": "rest_h", "a_rest": "rest_a"})
    out = m.select("match_id", "date", "div", "home", "away", "hg", "ag", "cards", "referee", "oh", "od", "oa", "ch", "cd", "ca").join(sides, "match_id")
    out = out.join(rated.select("match_id", (F.col("elo_h") - F.col("elo_a")).alias("elo_diff"), "exp_h"), "match_id").join(form.head_to_head(m), "match_id")
    label = F.when(F.col("hg") > F.col("ag"), 0.0).when(F.col("hg") == F.col("ag"), 1.0).otherwise(2.0)
    return out.withColumns({"label": label, "over": (F.col("hg") + F.col("ag") > 2).cast("double")})


def split(rows: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The first share of days for training, the rest for testing: a threshold on the date, never a random split."""
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    edge = rows.select(day.cast("double").alias("d")).approxQuantile("d", [share], 0.001)[0]
    return rows.where(day <= edge), rows.where(day > edge)


def prepared(cols: list[str], scale: bool = True) -> list:
    steps = [Imputer(inputCols=cols, outputCols=[f"_{c}" for c in cols], strategy="median"), VectorAssembler(inputCols=[f"_{c}" for c in cols], outputCol="raw")]
    return [*steps, StandardScaler(inputCol="raw", outputCol="features", withMean=True)] if scale else [*steps[:1], VectorAssembler(inputCols=[f"_{c}" for c in cols], outputCol="features")]


def as_doubles(rows: DataFrame, cols: list[str]) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("double") for c in cols})


def estimator(label: str = "label", penalty: float = 0.01) -> LogisticRegression:
    return LogisticRegression(labelCol=label, family="auto", regParam=penalty, maxIter=50)


def logistic(cols: list[str], label: str = "label", penalty: float = 0.01) -> Pipeline:
    return Pipeline(stages=[*prepared(cols), estimator(label, penalty)])


def boosted(cols: list[str], label: str = "label", classes: int = 3, trees: int = 5, depth: int = 3) -> Pipeline:
    """Boosted trees; for three classes one against the rest, as Spark's boosting is binary."""
    tree = GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, seed=7)
    return Pipeline(stages=[*prepared(cols, scale=False), tree if classes == 2 else OneVsRest(classifier=tree, labelCol=label, rawPredictionCol="rawPrediction")])


def poisson(cols: list[str], label: str, penalty: float = 0.01) -> Pipeline:
    return Pipeline(stages=[*prepared(cols), GeneralizedLinearRegression(family="poisson", link="log", labelCol=label, regParam=penalty, maxIter=25, predictionCol=f"rate_{label}")])


def strengths(weight: str | None = None) -> Pipeline:
    """Attack and defence strengths: a Poisson model of goals on one-hot scorer, one-hot opponent and the home flag."""
    index = StringIndexer(inputCols=["attack", "defence"], outputCols=["ai", "di"], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=["ai", "di"], outputCols=["av", "dv"])
    glm = GeneralizedLinearRegression(family="poisson", link="log", labelCol="goals", regParam=0.5, maxIter=15, predictionCol="rate")
    return Pipeline(stages=[index, hot, VectorAssembler(inputCols=["av", "dv", "at_home"], outputCol="features"), glm.setWeightCol(weight) if weight else glm])


def goal_rows(m: DataFrame) -> DataFrame:
    return m.select("match_id", "date", F.explode(F.array(
        F.struct(F.col("home").cast("string").alias("attack"), F.col("away").cast("string").alias("defence"), F.lit(1.0).alias("at_home"), F.col("hg").cast("double").alias("goals")),
        F.struct(F.col("away").cast("string").alias("attack"), F.col("home").cast("string").alias("defence"), F.lit(0.0).alias("at_home"), F.col("ag").cast("double").alias("goals")))).alias("r")).select("match_id", "date", "r.*")


def three(scored: DataFrame) -> DataFrame:
    """`scored` with p0, p1, p2 summing to one, from probabilities or one-against-rest scores."""
    if "probability" in scored.columns:
        p = vector_to_array("probability")
    else:
        p = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-x)))
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return scored.withColumns({f"p{k}": F.get(p, k) / total for k in range(3)})


def evaluated(scored: DataFrame, name: str) -> DataFrame:
    """(model, n, accuracy, logloss) of three-way probabilities p0..p2 against label."""
    return evaluated_by(scored).select(F.lit(name).alias("model"), "*")


def evaluated_by(scored: DataFrame, *keys: str) -> DataFrame:
    """(keys.., n, accuracy, logloss), a row for each value of the keys."""
    own = F.when(F.col("label") == 0, F.col("p0")).when(F.col("label") == 1, F.col("p1")).otherwise(F.col("p2"))
    best = F.greatest("p0", "p1", "p2")
    hit = F.when(F.col("p0") == best, 0.0).when(F.col("p1") == best, 1.0).otherwise(2.0) == F.col("label")
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(hit.cast("int")).alias("accuracy"), F.avg(-F.log(F.greatest(own, F.lit(1e-9)))).alias("logloss"))


def ablation(rows: DataFrame, base: list[str], extra: list[str], adopt_below: float = -0.001) -> DataFrame:
    """The same model with and without extra features on the same split, and the verdict."""
    train, test = split(rows)
    with_, without = (evaluated(three(logistic(c).fit(train).transform(test)), n) for c, n in ((base + extra, "with"), (base, "base")))
    out = without.select("n", F.col("logloss").alias("base")).join(with_.select(F.col("logloss").alias("with")), how="cross")  # one row each
    return out.withColumns({"delta": F.col("with") - F.col("base"), "verdict": F.when(F.col("with") - F.col("base") < adopt_below, "adopt").otherwise("reject")})


def tuned(rows: DataFrame, cols: list[str], penalties: list[float], k: int = 4) -> DataFrame:
    """(penalty, fold, logloss) on expanding time folds.  A row is stored once, with the fold that tests it (0: none), and a
    fold's features are prepared once for all penalties."""
    n = form.numbered(rows.select("match_id", "date", "label", *cols)).join(rows.agg(F.count("*").alias("all")), how="cross")  # one row
    size = F.expr(f"all div {k + 1}")
    fold = F.when(size > 0, F.greatest(F.ceil((F.col("n") - F.col("all") + k * size) / size), F.lit(0))).otherwise(0)
    table = stored(n.select("label", *cols, fold.cast("int").alias("fold")))
    out = None
    for f in range(1, k + 1):
        train, test = table.where(F.col("fold") < f), table.where(F.col("fold") == f)
        ready = Pipeline(stages=prepared(cols)).fit(train)
        train, test = (ready.transform(x).select("label", "features") for x in (train, test))
        for p in penalties:
            one = evaluated(three(estimator(penalty=p).fit(train).transform(test)), str(p)).select(F.lit(p).alias("penalty"), F.lit(f).alias("fold"), "logloss")
            out = one if out is None else out.unionByName(one)
    return out


def blocked(rows: DataFrame, folds: int = 4) -> DataFrame:
    """`rows` with block: 0 for what every fold learns from, then 1 to `folds` for the last equal blocks in order of time."""
    n = form.numbered(rows.select("match_id", "date")).join(rows.agg(F.count("*").alias("all")), how="cross")  # one row
    size = F.greatest(F.expr(f"all div {folds + 1}"), F.lit(1))
    block = F.greatest(F.floor((F.col("n") - 1 - (F.col("all") - folds * size)) / size) + 1, F.lit(0))
    return rows.join(n.select("match_id", block.cast("int").alias("block")), "match_id")


def search(rows: DataFrame, cols: list[str], candidates: list, folds: int = 4) -> DataFrame:
    """(place, rounds, depth, rate, l2, least, gain, share, folds, logloss, best): boosted candidates by their mean log-loss on
    expanding time folds; all candidates and folds grow in the same passes."""
    edges = boosting.cut_points(rows, cols)
    table = boosting.packed(blocked(rows, folds), cols, edges, block="block")
    found = boosting.searched(table, cols, edges, candidates, folds)
    out = [(k + 1, p.rounds, p.depth, p.rate, p.l2, p.least, p.gain, p.share, n, float(loss), k == 0) for k, (p, loss, n) in enumerate(found)]  # a row a candidate
    return rows.sparkSession.createDataFrame(out, "place int, rounds int, depth int, rate double, l2 double, least double, gain double, share double, folds int, logloss double, best boolean")


def gate(rows: DataFrame, base: list[str], extra: list[str], windows: int = 5, helped: int = 4, below: float = -0.001, params=None) -> DataFrame:
    """(win, n, base, with, delta, verdict): one configuration with and without `extra` on the last `windows` equal windows, each
    learned from all before it.  Adopt if the mean of the differences is below `below` and at least `helped` windows gain."""
    params = params or boosting.Params(rounds=10, depth=3, rate=0.25)
    cut = stored(blocked(rows, windows))
    losses = []
    for cols in (base, base + extra):
        edges = boosting.cut_points(cut, cols)
        each = [boosting.Params(**{**vars(params), "fold": f}) for f in range(1, windows + 1)]
        losses.append([m.curve[-1][2:] for m in boosting.fit_many(boosting.packed(cut, cols, edges, block="block"), cols, edges, each)])
    pairs = [(w + 1, int(a[0]), a[1] / a[0], b[1] / b[0]) for w, (a, b) in enumerate(zip(*losses)) if a[0]]
    deltas = [y - x for _, _, x, y in pairs]
    adopt = bool(deltas) and sum(deltas) / len(deltas) < below and sum(d < 0 for d in deltas) >= helped
    out = [(w, n, float(x), float(y), float(y - x), "adopt" if adopt else "reject") for w, n, x, y in pairs]  # a row a window
    return rows.sparkSession.createDataFrame(out, "win int, n long, base double, with double, delta double, verdict string")
