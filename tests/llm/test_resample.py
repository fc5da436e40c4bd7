"""Importance resampling against a plain computation, and ranks by regular sampling against a sort."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm.common import cut
from tallyloom.llm.resample import Features, Shift, ranked, resample

DOCS = "doc_id long, text string"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))
    return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(docs, bench, percent):
    s, t = Counter(b for _, x in docs for b in features(x)[1]), Counter(b for _, x in bench for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for i, x in docs:
        w, f = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(repr, (r[:5] for r in rows)))


def got(df):
    return sorted(repr([r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]]) for r in df.collect())


def test_shifted_crcs_are_those_of_whole_texts():
    rng = random.Random(1)
    shift = Shift()
    for _ in range(200):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 64, 65, 200]))) for _ in range(2))
        assert int(shift(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_features_of_each_text_stay_apart():
    texts = ["", "One", "two THREE", "É é a1-b2 \x7f c", None, "x " * 50, "w" * 300 + " y " + "z" * 130]
    sizes, found = Features()([None if t is None else t.encode() for t in texts])
    assert sizes.tolist() == [len(features(t)[0]) for t in texts]
    assert Counter(b for _, buckets in found for b in buckets.tolist()) == Counter(b for t in texts for b in features(t)[1])


def test_resampling_equals_a_plain_computation(spark):
    rng = random.Random(2)
    prose = lambda n, v: " ".join(f"W{rng.randrange(v)}" for _ in range(n))
    docs = [(k, prose(rng.choice([0, 5, 19, 20, 21, 80]), 300)) for k in range(200)] + [(7, prose(40, 50)), (7, None), (None, prose(30, 50)), (None, None), (300, prose(60_000, 2000))]
    docs += [(400, "same words " * 15)] * 90
    bench = [(1, prose(200, 50)), (2, None), (3, "")]
    frame = spark.createDataFrame(docs, DOCS).repartition(5).withColumns({"rank": F.lit("x"), "n_words": F.lit(1)})
    for percent in (5, 50, 100):
        assert got(resample(frame, spark.createDataFrame(bench, DOCS), percent)) == plain(docs, bench, percent)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b " * 20)], DOCS)
    assert not resample(none, one).count() and resample(none, one).columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert got(resample(one, none, 100)) == plain([(1, "a b " * 20)], [], 100)
    words = resample(one.select(F.lit("k").alias("doc_id"), "text"), none, 100).first()
    assert words["doc_id"] == "k" and words["rank"] == 1


def test_ranks_with_a_third_of_the_rows_tied(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, rng.randrange(50)]), rng.randrange(30)) for _ in range(4000)] + [(5, 12)] * 2000
    frame = spark.createDataFrame(rows, "_id long, score long").repartition(9)
    frame = cut(frame.withColumns({"_row": F.monotonically_increasing_id(), "eligible": F.col("score") > 0}))
    able = sorted((r for r in rows if r[1] > 0), key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    for draws in (0, 1, 700, len(able)):
        out = ranked(frame, draws, 40).collect()
        assert len(out) == len(rows)
        assert [(r["_id"], r["score"]) for r in sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])] == able[:draws]
        assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, draws + 1))
