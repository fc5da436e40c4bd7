"""Operators on small tables with odd rows, against brute force."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.llm.chat import digest_conversations, format_conversations
from tallyloom.llm.decontaminate import contamination
from tallyloom.llm.html_text import main_text, train
from tallyloom.llm.line_dedup import dedup_lines
from tallyloom.llm.ngram_join import similar_components
from tallyloom.llm.packing import pack, word_tokens
from tallyloom.llm.passages import repeated_passages
from tallyloom.llm.quality import classify, fit
from tallyloom.llm.token_files import read_tokens, write_tokens
from tallyloom.llm.topk import top_k

DOCS = "doc_id long, text string"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_contamination(spark):
    rng = random.Random(1)
    items = [(k, prose(rng, n, 40)) for k, n in enumerate([0, 1, 2, 3, 5, 8, 12, 13, 14, 40, 40])] + [(11, None), (12, "...")]
    items[10] = (10, items[9][1])
    docs = [(k, prose(rng, 60, 40) + " " + (items[k % 13][1] or "") + ". " + prose(rng, 20, 40)) for k in range(20)] + [(20, None), (21, ""), (21, items[9][1].upper()), (22, items[9][1] * 30), (None, items[8][1])]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
    want = []
    for i, t in docs:
        w, hit, own = words(t), set(), set()
        for j, x in items:
            x = words(x)
            n = min(len(x), 13)
            grams = {tuple(x[a : a + n]) for a in range(len(x) - n + 1)} if n else set()
            for a in range(len(w) - n + 1 if n else 0):
                if tuple(w[a : a + n]) in grams:
                    hit.update(range(a, a + n))
                    own.add(str(j))
        want.append((str(i), len(w), len(hit), sorted(own)))
    got = contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    empty = contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(empty) == len(docs) and not any(r["n_hit"] for r in empty)


def test_line_dedup(spark):
    rng = random.Random(2)
    common = ["  The Same Line here\t", "the same line HERE", "short", "", "ÜBER die lange Zeile", "über die lange Zeile"]
    docs = [(k, "\n".join(rng.choice(common + [prose(rng, 4)]) for _ in range(rng.randint(1, 6)))) for k in range(40)] + [(40, None), (41, ""), (3, "the same line here"), (None, "the same line here")]
    key = lambda x: x.strip(" \t\n\v\f\r").translate(ASCII)
    holders = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                holders[key(x)].add(i)
    want = []
    for i, t in docs:
        x = (t or "").split("\n")
        kept = [y for y in x if i is None or len(holders[key(y)]) < 2 or min(holders[key(y)]) == i]
        want.append((str(i), "\n".join(kept), len(x), len(x) - len(kept), "s"))
    df = spark.createDataFrame(docs, DOCS).withColumns({"n_lines": F.lit("clash"), "shard": F.lit("s")})
    for heavy_from in (100_000, 3, 2):  # all keys by the perfect hash; common ones, and all, by the broadcast
        got = [(str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"], r["shard"]) for r in dedup_lines(df, heavy_from=heavy_from).collect()]
        assert sorted(got) == sorted(want)
    assert dedup_lines(df.limit(0)).count() == 0


def test_ngram_join(spark):
    rng = random.Random(3)
    base = prose(rng, 90).split()
    docs = []
    for k in range(60):
        w = list(base) if k % 2 else prose(rng, 90).split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        docs.append((k, " ".join(w)))
    passage = prose(rng, 20)
    docs += [(100 + k, passage + " " + prose(rng, 12)) for k in range(25)] + [(200, "one two"), (201, "ONE\u000btwo"), (202, None), (203, " "), (204, docs[0][1]), (1, docs[1][1])]
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII))
        sets[i] = {tuple(w[a : a + 5]) for a in range(max(len(w) - 4, 1))} if w else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_components(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {i: (len(s), top(i)) for i, s in sets.items()}
    assert similar_components(spark.createDataFrame([], DOCS)).count() == 0


def test_passages(spark):
    rng = random.Random(4)
    passage = prose(rng, 70).split()
    edited = list(passage)
    del edited[35]
    hot = prose(rng, 60)
    docs = [(1, prose(rng, 100) + " " + " ".join(passage) + " " + prose(rng, 50)), (2, prose(rng, 30) + " " + " ".join(passage)), (3, " ".join(edited) + " " + prose(rng, 90)), (4, prose(rng, 200)), (5, None), (6, "short"), (7, prose(rng, 80)), (8, " ".join(passage[:40]) + " " + prose(rng, 60))]
    docs += [(9, docs[6][1]), (10, prose(rng, 45) + " " + hot + " " + hot)] + [(20 + k, prose(rng, 30) + " " + hot + " " + prose(rng, 30)) for k in range(15)]
    got = defaultdict(list)
    for r in repeated_passages(spark.createDataFrame(docs, DOCS)).collect():
        got[r["doc_id"]].append((r["start"], r["end"], r["class_id"]))
    assert set(got) == {1, 2, 3, 7, 9, 10, *range(20, 35)}
    assert got[1][0][0] <= 100 and got[1][0][1] >= 170 and {c for i in (1, 2, 3) for *_, c in got[i]} == {1}
    assert got[7] == got[9] == [(0, 80, 7)]
    assert all(got[20 + k][0][0] <= 30 and got[20 + k][0][1] >= 90 and got[20 + k][0][2] == 10 for k in range(15))


def test_quality(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for k in range(400):
        toxic, low = k % 5 == 0, k % 7 == 0
        words = prose(rng, 40, 300).split()
        if toxic:
            words[k % 40] = "nastyword"
        docs.append((k, " ".join(w.upper() + "!!" for w in words) if low else " ".join(words), f"s{k % 3}", "en"))
        if k < 250:
            labels.append((k, int(not low), int(toxic)))
    docs += [(400, None, None, None), (401, "", "s0", "en")]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in classify(d, fit(d, lab)).collect()}
    assert len(got) == len(docs)
    held = range(250, 400)
    assert sum((got[k]["p_toxic"] > 0.5) == (k % 5 == 0) for k in held) >= 147 and sum((got[k]["p_low"] > 0.5) == (k % 7 == 0) for k in held) >= 147
    assert all(r["keep"] for r in classify(d, fit(d, lab.limit(0))).collect())


def test_packing(spark):
    rng = random.Random(6)
    docs = [(k, prose(rng, int(rng.paretovariate(0.8) * 5) % 500)) for k in range(300)] + [(300, None), (301, ""), (None, "a b"), (5, "a b")]
    got = pack(spark.createDataFrame(docs, DOCS), word_tokens(F.col("text")), context=64, budget=256, buckets=5).collect()
    total = Counter()
    rooms = defaultdict(list)
    for r in got:
        total[r["doc_id"]] += r["n_tokens"]
        assert 0 < r["n_tokens"] <= r["bound"] <= 64
        rooms[r["bucket"], r["batch"]].append(r)
    want = Counter()
    for i, t in docs:
        want[i] += len((t or "").split()) + 1
    assert total == want
    for (bucket, batch), rows in rooms.items():
        room = 256 // rows[0]["bound"]
        assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and (len(rows) == room or batch == max(b for k, b in rooms if k == bucket))
    assert pack(spark.createDataFrame([], DOCS), word_tokens(F.col("text"))).count() == 0


def test_chat(spark):
    rows = [(1, 1, "assistant", "hi </turn> ###"), (1, 0, "user", None), (1, 1, "assistant", "hi </turn> ###"), (2, None, None, "x"), (None, 0, "assistant", "\\"), (3, 0, "a: b\n", "### user: t</turn>\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in digest_conversations(format_conversations(df)).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own) and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert digest_conversations(format_conversations(df.limit(0))).count() == 0


def test_token_files(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rng = random.Random(7)
    docs = [(k, prose(rng, rng.randint(0, 60))) for k in rng.sample(range(1000), 50)] + [(None, "x"), (3000, None), (3001, "b"), (3001, "a")]
    manifest = write_tokens(spark.createDataFrame(docs, DOCS), str(tmp_path / "ids"), public.path("byte_bpe_50k.json"))
    got = [tuple(r) for r in read_tokens(manifest).orderBy("start").collect()]
    t, at, want = Tokenizer.from_file(public.path("byte_bpe_50k.json")), 0, []
    for i, x in sorted(((-1 if i is None else i, x or "") for i, x in docs)):
        ids = b"".join(k.to_bytes(4, "little") for k in [*t.encode(x, add_special_tokens=False).ids, 0])
        want.append((None if i < 0 else i, at, ids))
        at += len(ids) // 4
    assert [(i, s, bytes(b)) for i, s, b in got] == want
    assert read_tokens(write_tokens(spark.createDataFrame([], DOCS), str(tmp_path / "none"), public.path("byte_bpe_50k.json"))).count() == 0


def test_html(spark):
    body = lambda k: f"<html><head><title>t{k}</title></head><body><nav><ul><li><a href='/x'>menu {k}</a></li></ul></nav><div class='ad'>Buy {k} now.</div><article><h1>Title {k}</h1><p>First paragraph of page {k}, it says things.</p><p>Second &amp; last  paragraph {k}.</p></article><footer>foot {k}</footer></body></html>"
    pages = [(k, "u", body(k)) for k in range(60)] + [(60, "u", None), (61, None, ""), (62, "u", body(62).replace("</article>", "<section class='comments'><div class='comment'><p>Nice one, reader here.</p></div></section></article>"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in main_text(df, train(df)).collect()}
    for k in [*range(60), 62]:
        assert got[k] == f"Title {k}\nFirst paragraph of page {k}, it says things.\nSecond & last paragraph {k}."
    assert got[60] == got[61] == ""


def test_topk(spark):
    rng = random.Random(8)
    rows = [(k, [rng.gauss(0, 0.2) for _ in range(12)]) for k in range(300)]
    rows += [(300 + k, rows[50][1]) for k in range(20)] + [(400, None), (450, [None] + [0.0] * 11), (500, [float("nan")] * 12), (550, [float("inf")] * 12), (None, rows[0][1])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    import numpy as np

    fit = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = []
    for q in fit:
        if q % 50 == 0:
            best = sorted((-int(fit[q] @ v), i) for i, v in fit.items() if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, "/root/testdata/sf0.001")
        assert new.columns == docs.columns
        docs = spark.createDataFrame(new.collect(), new.schema)
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept <= ids and (name != "lines" or kept == ids)
        ids = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in packed} == ids and ids
