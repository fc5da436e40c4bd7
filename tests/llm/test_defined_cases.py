"""Defined cases of the operators: empty tables, clashing columns, repeated rows, null ids, few candidates, very long texts."""

import time

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import html_text, topk
from tallyloom.llm.decontaminate import contamination
from tallyloom.llm.packing import pack, word_tokens

VECTORS = "vec_id long, embedding array<float>, _id string, score string, rank int, block int"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, "x", "y", 1, 2) for k, v in rows], VECTORS)


def best(rows, k, asked):
    whole = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for i, q in {i: q for i, q in whole if asked(i)}.items():
        scored = sorted(((-int((q * v).sum()), j) for j, v in whole if j != i))[:k]
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def test_topk_with_few_rows_odd_vectors_and_clashing_columns(spark):
    rows = [(0, [0.5, -0.25]), (50, [0.1, 0.9]), (1, [0.5, -0.25]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 0.0]), (None, [1.0, 1.0]), (5, [float("inf"), 0.0])]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == best(rows, 5, lambda i: i % 50 == 0)
    assert topk.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(vectors(spark, rows), F.col("vec_id") < 0).count() == 0


def test_topk_in_many_blocks_from_a_kept_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 5)
    rng = np.random.default_rng(3)
    rows = [(k, np.round(rng.normal(size=6), 1).tolist()) for k in range(400)] + [(400 + k, [1.5] * 6) for k in range(90)]
    made = topk.build_index(vectors(spark, rows), path=str(tmp_path / "index"))
    assert made.count() > 4
    kept = spark.read.parquet(str(tmp_path / "index"))
    for step in (50, 17):
        got = topk.search(kept, vectors(spark, [r for r in rows if r[0] % step == 0]))
        assert sorted(map(tuple, got.collect())) == best(rows, 5, lambda i, step=step: i % step == 0)


def test_packing_deals_rows_without_ids(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit(1).alias("salt"))
    got = pack(df, word_tokens(F.col("text")), context=8, budget=16)
    rows = got.collect()
    assert len(rows) == 4000 and {r["n_tokens"] for r in rows} == {4}
    assert sorted((r["batch"], r["slot"]) for r in rows) == [(b, s) for b in range(1000) for s in range(4)]


def test_contamination_counts_items_without_ids(spark):
    shared = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"before {shared} after", "i"), (2, "nothing of it", "i"), (None, shared, "i")], "doc_id long, text string, item string")
    bench = spark.createDataFrame([(None, shared), ("b", shared), ("a", shared), ("a", shared)], "item_id string, text string")
    got = {r[0]: tuple(r)[1:] for r in contamination(docs, bench).collect()}
    assert got == {1: (22, 20, ["a", "b"]), 2: (3, 0, []), None: (20, 20, ["a", "b"])}
    nameless = contamination(docs, bench.where("item_id is null"))
    assert {r[0]: (r[2], r[3]) for r in nameless.collect()} == {1: (20, []), 2: (0, []), None: (20, [])}
    assert contamination(docs.limit(0), bench).count() == 0 and contamination(docs, bench.limit(0)).count() == 3


def test_contamination_in_a_very_long_text(spark):
    shared = " ".join(f"w{k}" for k in range(30))
    filler = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(200_000)), lambda k: F.concat(F.lit("f"), k.cast("string"))), " ")
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", filler, F.lit(shared), filler).alias("text"))
    row = contamination(docs, spark.createDataFrame([("i", shared)], "item_id string, text string")).first()
    assert tuple(row) == (0, 400_032, 30, ["i"])


def test_parsing_is_linear_in_the_page():
    def seconds(n):
        began = time.process_time()
        assert sum(len(t) for _, t, _ in html_text.blocks("<article><p>" + "<b>x</b> " * n + "<i>y " * n)) > n
        return time.process_time() - began

    seconds(1000)
    short, long = seconds(10_000), seconds(80_000)
    assert long < 20 * short + 0.5  # eight times the page; quadratic work would take 64 times as long


def test_html_cases(spark):
    html = "<html><body><nav><a href='/'>Home</a></nav><article><p>Some words, and more of them; they end here.</p></article></body></html>"
    pages = spark.createDataFrame([(1, html, "old", 7), (1, html, "old", 7), (None, None, None, None), (3, "", "old", 7)], "page_id long, html string, text string, n_chars int")
    got = html_text.main_text(pages, html_text.train(pages))
    assert got.columns == pages.columns
    assert sorted((r["page_id"] or 0, r["text"]) for r in got.collect()) == [(0, "")] + [(1, "Some words, and more of them; they end here.")] * 2 + [(3, "")]
    kept = html_text.main_text(pages, html_text.Chain(), out_col="main")
    assert kept.columns == [*pages.columns, "main"] and kept.where("text = 'old'").count() == 3
    assert html_text.main_text(pages.limit(0), html_text.train(pages.limit(0))).count() == 0
