"""Sharding by virtual slots: sizes, places, versions, and what may move."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import sharding
from tallyloom.llm.sharding import SLOTS, SlotMaps, balanced_shards, dealt, grown, loads, rebalanced, sharded, sized, slot_sums

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_rebalancing_evens_the_bytes(shards):
    rng = np.random.default_rng(shards)
    for size in (rng.integers(1000, 3000, SLOTS), (rng.pareto(1.5, SLOTS) * 1000).astype(np.int64), np.r_[rng.integers(1, 500, 200), np.zeros(SLOTS - 200, np.int64)]):
        owner = rebalanced(dealt(shards), size, shards)
        load = loads(owner, size, shards)
        assert load.sum() == size.sum() and load.max() - load.min() <= size.max()
        again = rebalanced(owner, size, shards)
        assert (again == owner).all()


def test_one_huge_slot_stays_alone():
    size = np.ones(SLOTS, np.int64)
    size[5] = 10 * SLOTS
    load = sorted(loads(rebalanced(dealt(4), size, 4), size, 4))
    assert load[-1] == 10 * SLOTS and load[2] - load[0] <= 1


def test_growing_moves_into_the_new_shard_alone():
    rng = np.random.default_rng(3)
    size = rng.integers(1000, 3000, SLOTS)
    before = rebalanced(dealt(40), size, 40)
    after = grown(before, size, 40)
    assert set(after[after != before]) == {40}
    load = loads(after, size, 41)
    assert 0.99 * size.sum() / 41 <= load[40] <= size.sum() / 41 and load.max() <= 1.01 * size.sum() / 41
    assert (grown(before, np.zeros(SLOTS, np.int64), 40) == before).all()


def check(rows, docs, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    at, load = defaultdict(list), Counter()
    for r in rows:
        at[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in at.values()) and set(at) <= set(range(shards))
    return load


def test_documents_are_sharded_evenly(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 100)
    rng = random.Random(4)
    docs = [(k, "é" * rng.randrange(300)) for k in range(3000)] + [(None, None)] * 900 + [(7, "same")] * 900 + [(8, ""), (9, "x" * 200_000)]
    frame = spark.createDataFrame(docs, DOCS).repartition(6).withColumns({"shard": F.lit("x"), "slot": F.lit(1.5), "size": F.lit(None)})
    load = check(balanced_shards(frame, 5).collect(), docs, 5)
    assert max(load.values()) - min(load.values()) <= 900 * 20  # rows with equal id and text share a slot


def test_equal_texts_spread(spark):
    docs = [(k, "copy " * 20) for k in range(4000)]
    load = check(balanced_shards(spark.createDataFrame(docs, DOCS), 40).collect(), docs, 40)
    assert len(load) == 40 and max(load.values()) <= 1.05 * min(load.values())


def test_versions(spark, tmp_path):
    docs = spark.createDataFrame([(k, "t" * (k % 50)) for k in range(2000)], DOCS)
    maps = SlotMaps(spark, str(tmp_path / "maps"))
    maps.publish(0, dealt(8))
    assert {r["version"] for r in balanced_shards(docs, 8, maps).select("version").distinct().collect()} == {1}
    first = maps.load(1)[1]
    rows = sized(docs)
    size, count = slot_sums(rows)
    assert maps.edit(lambda owner: grown(owner, size, 8)) == 2
    old = {r["_id"]: r["shard"] for r in sharded(rows, maps.frame(1), count).collect()}
    new = {r["_id"]: r["shard"] for r in sharded(rows, maps.frame(2), count).collect()}
    assert {new[k] for k in new if new[k] != old[k]} == {8} and (maps.load(1)[1] == first).all()
    with pytest.raises(Exception):
        maps.publish(2, first)
    spark.createDataFrame([(0, 0)], "slot int, shard int").write.parquet(str(tmp_path / "maps/version=3"))  # cut short
    assert maps.load()[0] == 2


def test_empty_table(spark):
    out = balanced_shards(spark.createDataFrame([], DOCS), 40)
    assert out.count() == 0 and out.columns == ["doc_id", "size", "text_crc32", "vslot", "version", "shard", "slot"]
