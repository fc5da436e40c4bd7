"""Spelling variants against brute force over all pairs of small vocabularies."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.llm.spelling import near_in_list, near_pairs, variants, vocabulary

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("letters,least,most", [("ab", 0, 6), ("abc", 3, 5), ("abcdefghij", 7, 9), ("a", 0, 40), ("aé", 7, 8)])
def test_scan_of_a_sorted_list(letters, least, most):
    rng = random.Random(letters)
    for _ in range(60):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(least, most))) for _ in range(rng.choice([0, 1, 2, 30, 60]))})
        words = sorted({*words, *("".join(c for k, c in enumerate(w) if k != rng.randrange(len(w) or 1)) for w in words[::3])})
        assert sorted(near_in_list(words)) == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])]


def plain(counts):
    near = defaultdict(list)
    for a in counts:
        near[a] = [b for b in counts if one_edit(a, b)]
    form = {}
    for w in counts:
        best = min(near[w], key=lambda b: (-counts[b], b), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    rows = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(map(repr, rows))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("most", [2000, 6])
def test_variants_of_a_vocabulary(spark, most):
    rng = random.Random(most)
    words = {"".join(rng.choice("abcdé") for _ in range(rng.choice([7, 8, 9, 12]))) for _ in range(250)}
    words |= {"aaaaaaa" + "".join(rng.choice("abc") for _ in range(rng.choice([3, 4, 5]))) for _ in range(150)}  # a third with one beginning
    words |= {"".join(rng.choice("abc") for _ in range(4)) + "zzzzzzzz" for _ in range(60)} | {"q" * 3000, "q" * 3001}
    for w in list(words)[:150]:
        k = rng.randrange(len(w))
        words.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + "e" + w[k:], w[:k] + "e" + w[k + 1 :]]))
    counts = {w: rng.choice([2, 2, 3, 25, 400, 400, 5000, 70000]) for w in words if len(w) >= 7}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = near_pairs(frame, most).collect()
    assert len(pairs) == len({(r["word"], r["near"]) for r in pairs})
    assert got(variants(frame, most=most)) == plain(counts)


def test_whole_query_on_texts(spark):
    rng = random.Random(9)
    base = ["Repository", "évidences", "Straße", "abcdefg", "ABCDEFGH", "naïveté×÷", "x" * 5000, "repositery", "don't-stopping"]
    docs = [(k, " ".join(rng.choice(base) for _ in range(60)) + "9") for k in range(80)] + [(3, "repository"), (3, "repository"), (None, "Repository évidences"), (4, None), (5, "")]
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns({"word": F.lit(1), "n": F.lit("x")})
    assert got(variants(vocabulary(frame))) == plain(counts) and len(counts) > 5


def test_no_words(spark):
    out = variants(vocabulary(spark.createDataFrame([(1, None), (2, "short words only")], "doc_id long, text string")))
    assert out.count() == 0 and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert variants(vocabulary(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
