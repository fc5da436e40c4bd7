"""Quality and toxicity by hierarchical empirical Bayes.

1. Document evidence.  A document is a set of features: its words, their beginnings, and bins of its style (share of
   symbols, capitals, repeated words, length).  For each feature a grouped aggregation counts labelled documents and bad ones
   among them; the log-odds of its rate are shrunk towards zero by SHRINK pseudo-documents at the global rate.  A logistic
   model over a document's strongest features, fitted leaving each document out of its own counts, turns them into a
   probability.  Fitted on at most `sample` labelled rows (those with the smallest hash), with at most `features` features.
2. Sites.  Grouped aggregations over all documents give every host and every path (a second key within the host) its number
   of documents and expected bad ones.  Method of moments gives the strengths of two priors: hosts are shrunk towards the
   global rate, paths towards their host.  A sparse site therefore stays near its parent.
3. The log-odds of a document are those of its text plus the shift of its path from the global rate.  Its own score is taken
   out of its path's and its host's sums first, so that a document alone at its site moves nothing.

Sites are aggregated before they are shuffled and joined by key; adaptive execution splits the rows of a hot one.

Defined cases: null or empty texts have only their style; null hosts and paths are sites of their own; labels that are null
don't count; a repeated label counts each time; without labels, or with labels of one kind, nothing is rejected.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from operator import eq
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SAMPLE = 20_000
FEATURES = 20_000
SHRINK = 8.0
#: Words whose features a task remembers before it starts anew.
WORDS_KEPT = 200_000
STRIP = ".,;:!?()[]{}<>*$%&#|\"'`~^_=+-/\\"
SYMBOLS = b"*$%&#|<>{}[]=_~^@\\"
TARGETS = ("toxic", "low")


def _bin(name: str, share: float) -> str:
    return f"{name}:{round(2 * math.log2(share + 1 / 256))}"


def _style(text: str, written: list[str], words: list[str]) -> set[str]:
    raw = text.encode("utf-8", "surrogatepass")
    n, m = max(len(raw), 1), max(len(words), 1)
    return {
        _bin(" symbols", (len(raw) - len(raw.translate(None, SYMBOLS))) / n),
        _bin(" capitals", sum(map(str.isupper, written)) / m),
        _bin(" stutter", sum(map(eq, words, words[1:])) / m),
        _bin(" repeats", 1 - len(set(words)) / m if words else 0.0),
        f" words:{len(words).bit_length()}",
    }


def _of_word(word: str) -> list[str]:
    w = word.strip(STRIP)
    return [w, *[w[:k] + "-" for k in (3, 4, 5) if len(w) > k]] if w else []


def features(text: str | None) -> set[str]:
    text = text or ""
    words = text.lower().split()
    out = _style(text, text.split(), words)
    for w in set(words):
        out.update(_of_word(w))
    return out


def log_odds(bad: float, n: float, rate: float) -> float:
    """Shrunk log-odds of a feature against the global rate."""
    p = (bad + SHRINK * rate) / (n + SHRINK)
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p)) - math.log(rate / (1 - rate))


def _strongest(scores: list[float]) -> tuple[float, float]:
    scores.sort(reverse=True)
    return scores[0] if scores else 0.0, sum(scores[:5])


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Weights (bias first) of a logistic regression by Newton's method; x has few columns."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)) * len(x) ** 0.5
        step = np.linalg.solve(h, x.T @ (p - y) + penalty * len(x) ** 0.5 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Evidence:
    """The fitted document classifier: feature counts, global rates and logistic weights by target."""

    def __init__(self, counts: dict[str, tuple], n: int, bad: dict[str, int]):
        self.counts, self.n, self.bad, self.weights = counts, n, bad, {}
        self.rates = {t: bad[t] / n for t in TARGETS if n and 0 < bad[t] < n}

    def scored(self, own: set[str], label: dict[str, int] | None = None) -> dict[str, tuple[float, float]]:
        """By target, the strongest features' scores; with the document's own label taken out of the counts if given."""
        known = [self.counts[f] for f in own if f in self.counts]
        out = {}
        for i, t in enumerate(TARGETS):
            if t in self.rates:
                less = (1, label[t]) if label else (0, 0)
                out[t] = _strongest([log_odds(c[1 + i] - less[1], c[0] - less[0], self.rates[t]) for c in known])
        return out

    def judge(self) -> Callable[[str | None], list[float]]:
        """A function from texts to log-odds by target; it scores each feature once and remembers the known features of words."""
        rates = [self.rates.get(t) for t in TARGETS]
        scores = {f: tuple(log_odds(c[1 + i], c[0], r) if r else 0.0 for i, r in enumerate(rates)) for f, c in self.counts.items()}
        weights = [self.weights.get(t) for t in TARGETS]

        class Known(dict):
            """The known features of each word met; begun anew when WORDS_KEPT words are held."""

            def __missing__(self, word: str) -> tuple:
                if len(self) >= WORDS_KEPT:
                    self.clear()
                own = self[word] = tuple([f for f in _of_word(word) if f in scores])
                return own

        known = Known()

        def logit(text: str | None) -> list[float]:
            text = text or ""
            words = text.lower().split()
            own = {f for f in _style(text, text.split(), words) if f in scores}
            own.update(*map(known.__getitem__, set(words)))
            found = [scores[f] for f in own]
            return [float(w @ np.r_[1.0, _strongest([x[i] for x in found])]) if w is not None else -12.0 for i, w in enumerate(weights)]

        return logit


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", toxic_col: str = "toxic", sample: int = SAMPLE, limit: int = FEATURES) -> Evidence:
    spark = docs.sparkSession
    marked = labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull() & F.col(toxic_col).isNotNull())
    marked = marked.select(F.col(id_col).alias("_id"), (F.col(toxic_col) != 0).cast("int").alias("toxic"), (F.col(quality_col) == 0).cast("int").alias("low")).orderBy(F.xxhash64("_id"), "_id", "toxic", "low").limit(sample)
    known = cut(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(marked), "_id"))  # `sample` rows of three numbers at most

    def count(batches):
        for pdf in batches:
            n, toxic, low = Counter(), Counter(), Counter()
            for text, t, q in zip(pdf["_text"], pdf["toxic"], pdf["low"]):
                own = features(text)
                n.update(own)
                if t:
                    toxic.update(own)
                if q:
                    low.update(own)
            yield pd.DataFrame({"feature": list(n), "n": list(n.values()), "toxic": [toxic[f] for f in n], "low": [low[f] for f in n]})

    totals = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.sum("low").alias("low")).first()
    model = Evidence({}, totals["n"], {t: totals[t] or 0 for t in TARGETS})
    counts = known.mapInPandas(count, "feature string, n long, toxic long, low long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "low")])
    lift = F.greatest(*[(F.col(t) - F.col("n") * F.lit(model.rates.get(t, 1.0))) / F.sqrt(F.col("n") + F.lit(SHRINK)) for t in TARGETS])
    top = counts.where("n > 1").withColumn("lift", lift).orderBy(F.desc("lift"), "feature").limit(limit)
    top = cut(top)  # the model's fixed size; a checkpoint first, as a collected sort would send every task's candidates to the driver
    model.counts = {r["feature"]: (r["n"], r["toxic"], r["low"]) for r in top.collect()}
    shared = spark.sparkContext.broadcast(model)

    def own_scores(batches):
        for pdf in batches:
            rows = [(t, q, shared.value.scored(features(x), {"toxic": t, "low": q})) for x, t, q in zip(pdf["_text"], pdf["toxic"], pdf["low"])]
            yield pd.DataFrame([(t, q, *s.get("toxic", (0.0, 0.0)), *s.get("low", (0.0, 0.0))) for t, q, s in rows], columns=["toxic", "low", "t1", "t2", "l1", "l2"])

    x = known.mapInPandas(own_scores, "toxic int, low int, t1 double, t2 double, l1 double, l2 double").toPandas() if model.rates else None  # `sample` rows at most
    for t, cols in (("toxic", ["t1", "t2"]), ("low", ["l1", "l2"])):
        if t in model.rates:
            model.weights[t] = _logistic(x[cols].to_numpy(), x[t].to_numpy(float))
    shared.unpersist()
    return model


def _prior(sites: DataFrame, k: str, n: str, parent: str) -> float:
    """Strength of the Beta prior from the spread of site rates around their parents', by moments."""
    k, n, parent = F.col(k), F.col(n), F.col(parent)
    r = sites.where(n > 1).agg(
        F.sum(n * parent * (1 - parent)).alias("within"),
        F.sum(n * F.pow(k / n - parent, 2)).alias("between"),
        F.sum(n).alias("n"), F.count("*").alias("sites")).first()
    if not r["sites"] or not r["within"]:
        return 1e6
    spread = (r["between"] - r["within"] * r["sites"] / r["n"]) / (r["n"] - r["sites"] or 1)  # beyond what chance gives
    mean = r["within"] / r["n"]
    return float(min(max(mean / spread - 1, 1.0), 1e6)) if spread > 0 else 1e6


def _shrunk(k: Column, n: Column, strength: float, parent: Column) -> Column:
    """The posterior rate of a site with k of n under a Beta prior around its parent's rate."""
    rate = (F.greatest(k, F.lit(0.0)) + strength * parent) / (F.greatest(n, F.lit(0.0)) + strength)
    return F.greatest(F.least(rate, F.lit(1 - 1e-6)), F.lit(1e-6))


def classify(docs: DataFrame, model: Evidence, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang", reject: float = 0.5) -> DataFrame:
    """(id, p_toxic, p_low, site_toxic, site_low, keep): one row a document; site_* is what its site's other documents say."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("toxic double, low double")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        logit = shared.value.judge()
        for texts in batches:
            yield pd.DataFrame([logit(t) for t in texts], columns=list(TARGETS))

    scored = cut(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("_path"), evidence(text_col).alias("e")).select("_id", "_host", "_path", "e.*"))
    own = {t: 1 / (1 + F.exp(-F.col(t))) for t in TARGETS}
    paths = cut(scored.groupBy("_host", "_path").agg(F.count("*").cast("double").alias("n"), *[F.sum(own[t]).alias(f"k_{t}") for t in TARGETS]))
    whole = paths.agg(F.sum("n").alias("n"), *[F.sum(f"k_{t}").alias(t) for t in TARGETS]).first()
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("host_n"), *[F.sum(f"k_{t}").alias(f"host_k_{t}") for t in TARGETS])
    sites = cut(paths.join(hosts, "_host"))
    out = scored.join(sites, ["_host", "_path"])
    for t in TARGETS:
        rate = min(max((whole[t] or 0) / (whole["n"] or 1), 1e-6), 1 - 1e-6)
        host_strength = _prior(hosts.withColumn("parent", F.lit(rate)), f"host_k_{t}", "host_n", "parent")
        parent = _shrunk(F.col(f"host_k_{t}"), F.col("host_n"), host_strength, F.lit(rate))
        strength = _prior(sites.withColumn("parent", parent), f"k_{t}", "n", "parent")
        others = _shrunk(F.col(f"host_k_{t}") - own[t], F.col("host_n") - 1, host_strength, F.lit(rate))
        site = _shrunk(F.col(f"k_{t}") - own[t], F.col("n") - 1, strength, others)
        out = out.withColumn(f"site_{t}", site)
        shift = F.log(F.col(f"site_{t}") / (1 - F.col(f"site_{t}"))) - math.log(rate / (1 - rate))
        out = out.withColumn(f"p_{t}", 1 / (1 + F.exp(-(F.col(t) + shift))))
    return out.select(F.col("_id").alias(id_col), "p_toxic", "p_low", "site_toxic", "site_low", ((F.col("p_toxic") < reject) & (F.col("p_low") < reject)).alias("keep"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op3_quality": op3_quality}
ORACLE_SQL: dict[str, str] = {}
