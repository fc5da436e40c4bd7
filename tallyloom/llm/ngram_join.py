"""Exact Jaccard join of word n-gram sets through parity sketches, and the components of its links.

Sets A and B with Jaccard similarity of at least t differ in at most d = (1 - t) / (1 + t) * (|A| + |B|) shingles.

* Sketch: every shingle is XORed into one of P blocks (a 64-bit word) and flips one bit of a bit sketch.  One shingle in
  which two sets differ changes one block and one bit, so differing blocks and differing bits (the Hamming distance) both
  bound the symmetric difference from below.
* Pigeonhole join: of P blocks at least P - d agree.  Among the agreeing blocks consider the one that comes first when
  blocks are ordered by their content: fewer than d + 1 blocks of either set come before it, or more than d blocks would
  differ.  So each set sends only its first d + 1 blocks in that order, and two similar sets always meet in one.
* Order: blocks of rare shingles come first, then fuller ones.  How common a shingle is, is read from a table of BUCKETS
  counts over all documents (its size is a constant); it steers the order alone, so its collisions cost no link.  A line that a
  third of all documents share is thus sent only by those that hold little else.
* Size bands: P is fixed within a band [4^b, 4^(b+1)); a set also sends blocks to the next band if it has partners there.
* Candidates that meet are held against size and Hamming bounds and then verified on whole shingle sets.

Crowded blocks: up to SMALL members are paired directly.  A larger block links its members to a pivot of about their size
first, and components are taken; only blocks that then still hold more than one component are looked at again.  First every
member meets those of its largest such block, in tiles of TILE members, then all tiles of a block meet each other.  A task
compares the bit sketches of its tile's members and gives the shortest pairs that connect all within the Hamming bound (a
spanning forest: fewer pairs than members).  These are verified, components merge, and tiles that still hold unconnected
members within the bound are looked at again, the pairs tested before left out; when a round brings nothing new, all that are
left are given.  Copies with the same set count as one.  No link between different components is lost, and no group is expanded.

Defined cases: null or word-less texts have the empty set and no links; fewer than n words make one shingle; a null id is
left out of linking and returned with a null component; rows repeating an id are one document with the links of all its texts
and the size of the largest set.  Only the id and text columns are read; results have columns of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, cut, distinct, joined, mix, partitions, shingles, split_by, word_hashes
from .components import components, merged

SMALL = 8
TILE = 2048
WORDS_PER_SHARD = 5_000_000
FLUSH = 1_000_000
#: Counts of shingles, and how many a row of them holds.
BUCKETS, CHUNK = 1 << 18, 1 << 10


def band_of(n: int) -> int:
    return (n.bit_length() - 1) // 2


def blocks_in(band: int, similarity: int = 75) -> int:
    """Two for each set size of the band's start, or as many more as a low similarity asks for: a power of two above every d."""
    largest = most_apart(4 ** (band + 1), 4 ** (band + 1), similarity)
    return max(2 * 4**band, 1 << (largest + 1).bit_length())


def bits_in(band: int) -> int:
    return max(64, 2 * 4 ** (band + 1))


def most_apart(n: int, m: int, similarity: int) -> int:
    """Largest symmetric difference of sets of n and m shingles with 100 * intersection >= similarity * union."""
    return (n + m) * (100 - similarity) // (100 + similarity)


def homes(n: int, similarity: int):
    """(band, d): the bands a set of n shingles sends blocks to, and by how much partners there may differ."""
    band = band_of(n)
    end, largest = 4 ** (band + 1), n * 100 // similarity
    yield band, most_apart(n, min(end - 1, largest), similarity)
    if largest >= end:
        yield band + 1, most_apart(n, largest, similarity)


def bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)


def first_blocks(grams: np.ndarray, band: int, d: int, p: int | None = None, common: np.ndarray | None = None) -> np.ndarray:
    """Join keys of the first d + 1 blocks of a sorted set, in the order of their content; `common` ranks buckets of shingles."""
    p = p or blocks_in(band)
    at = ((grams >> np.uint64(32)) * np.uint64(p) >> np.uint64(32)).astype(np.int64)  # ascends with the set
    start = np.r_[0, np.flatnonzero(np.diff(at)) + 1]
    word = np.bitwise_xor.reduceat(grams, start)
    full = np.diff(np.r_[start, len(at)]).astype(np.uint64)
    rank = np.minimum.reduceat(common[bucket(grams)], start).astype(np.uint64) if common is not None else np.zeros(len(start), np.uint64)
    block = at[start]
    place = rank << np.uint64(56) | (np.uint64(255) - np.minimum(full, np.uint64(255))) << np.uint64(48) | word >> np.uint64(16)
    keep = np.argpartition(place, d)[: d + 1] if len(place) > d + 1 else np.arange(len(place))
    block, word = block[keep], word[keep]
    if len(block) <= d:  # empty blocks come last, in the order of their number
        empty = np.setdiff1d(np.arange(p), block)[: d + 1 - len(block)]
        block, word = np.r_[block, empty], np.r_[word, np.zeros(len(empty), np.uint64)]
    return mix(word ^ mix(np.uint64(band << 40) + block.astype(np.uint64)))


def bit_sketch(grams: np.ndarray, band: int) -> bytes:
    bits = bits_in(band)
    return np.packbits((np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two bit sketches, the longer one folded to the length of the shorter (folding keeps the lower bound)."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, n), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def signature(grams: np.ndarray) -> bytes:
    """Names a set of hashes: equal for equal sets."""
    both, total = (f.reduce(grams, keepdims=True) for f in (np.bitwise_xor, np.add))
    return mix(np.r_[both + total * MULT[0], total]).tobytes()


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """(_id, row, n, sig, s0, sketch, chunk) of the distinct shingles of `docs` (_id, _text).

    sig names the set, s0 is its first half, row is a number of its own.  Rows with a chunk of 0 or more hold a task's counts of
    shingles in place of a set.
    """

    def run(batches):
        from pyspark import TaskContext

        row, counts, held, many = TaskContext.get().partitionId() << 40, np.zeros(BUCKETS, np.int64), [], 0
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["_id"], pdf["_text"]):
                grams = distinct(shingles(word_hashes(text), n))
                row += 1
                if len(grams):
                    held.append(bucket(grams))
                    many += len(grams)
                    if many > FLUSH:
                        counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
                        held, many = [], 0
                    sig = signature(grams)
                    rows.append((i, row, len(grams), sig, int.from_bytes(sig[:8], "little", signed=True), bit_sketch(grams, band_of(len(grams))), -1))
                else:
                    rows.append((i, row, 0, b"", 0, b"", -1))
            yield pd.DataFrame(rows, columns=["_id", "row", "n", "sig", "s0", "sketch", "chunk"])
        counts += np.bincount(np.concatenate([np.zeros(0, np.int64), *held]), minlength=BUCKETS)
        rows = [(0, 0, 0, b"", 0, part.tobytes(), k) for k, part in enumerate(counts.reshape(-1, CHUNK)) if part.any()]
        yield pd.DataFrame(rows, columns=["_id", "row", "n", "sig", "s0", "sketch", "chunk"])

    return docs.mapInPandas(run, "_id long, row long, n long, sig binary, s0 long, sketch binary, chunk int")


def commonness(counts: DataFrame) -> np.ndarray:
    """Rank of each bucket of shingles: 0 where it isn't much fuller than the average, then by powers of two."""

    def add(key, pdf):
        total = np.zeros(CHUNK, np.int64)
        for part in pdf["sketch"]:
            total += np.frombuffer(part, np.int64)
        return pd.DataFrame({"chunk": [key[0]], "total": [total.tobytes()]})

    total = np.zeros((BUCKETS // CHUNK, CHUNK), np.int64)
    for r in counts.groupBy("chunk").applyInPandas(add, "chunk int, total binary").collect():  # BUCKETS / CHUNK rows at any size
        total[r["chunk"]] = np.frombuffer(r["total"], np.int64)
    usual = 2 * total.mean() + SMALL
    return np.maximum(np.floor(np.log2(np.maximum(total.ravel(), 1) / usual)) + 1, 0).astype(np.uint8)


def _send(docs: DataFrame, n: int, similarity: int, shards: int, common) -> DataFrame:
    """Join keys of every set, packed by shard; a task sends a set once, however many of its documents have it."""

    def pack(ids, sizes, counts, keys):
        keys = np.concatenate(keys)
        doc = np.repeat(np.arange(len(ids)), counts)
        ids, sizes = np.array(ids, np.int64), np.array(sizes, np.int32)
        shard = ((keys >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)
        rows = []
        for s, (k, d) in split_by(shard, keys, doc):
            own, many = np.unique(d, return_counts=True)
            rows.append((s, k.tobytes(), ids[own].tobytes(), sizes[own].tobytes(), many.astype(np.int32).tobytes()))
        return pd.DataFrame(rows, columns=["shard", "keys", "ids", "sizes", "many"])

    def run(batches):
        ids, sizes, counts, keys, total, sent = [], [], [], [], 0, set()
        for pdf in batches:
            for text in pdf["_text"]:
                grams = distinct(shingles(word_hashes(text), n))
                if not len(grams):
                    continue
                name = int.from_bytes(signature(grams)[:8], "little", signed=True)
                if name in sent:
                    continue
                sent.add(name)
                own = np.concatenate([first_blocks(grams, band, d, blocks_in(band, similarity), common.value) for band, d in homes(len(grams), similarity)])
                ids.append(name)
                sizes.append(len(grams))
                counts.append(len(own))
                keys.append(own)
                total += len(own)
                if total >= FLUSH:
                    yield pack(ids, sizes, counts, keys)
                    ids, sizes, counts, keys, total = [], [], [], [], 0
        if total:
            yield pack(ids, sizes, counts, keys)

    return docs.mapInPandas(run, "shard int, keys binary, ids binary, sizes binary, many binary")


def _meet(similarity: int):
    """Pairs of sets that share a block, and the members of crowded blocks (a = b)."""

    def run(key, pdf):
        keys = joined(pdf["keys"], np.uint64)
        many = joined(pdf["many"], np.int32)
        ids, sizes = np.repeat(joined(pdf["ids"], np.int64), many), np.repeat(joined(pdf["sizes"], np.int32), many).astype(np.int64)
        size_class = np.floor(np.log(sizes) / max(np.log(100 / similarity), 1e-9)).astype(np.int64)
        order = np.lexsort((ids, mix(ids.view(np.uint64)), size_class, keys))
        keys, ids, sizes, size_class = keys[order], ids[order], sizes[order], size_class[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])] if len(keys) else np.zeros(0, bool)
        keys, ids, sizes, size_class = keys[new], ids[new], sizes[new], size_class[new]
        start = np.r_[0, np.flatnonzero(np.diff(keys)) + 1] if len(keys) else np.zeros(0, np.int64)
        length = np.diff(np.r_[start, len(keys)])
        crowded = np.repeat(length > SMALL, length)
        alike = np.r_[0, np.flatnonzero((np.diff(keys) != 0) | (np.diff(size_class) != 0)) + 1] if len(keys) else start
        pivot = np.repeat(alike, np.diff(np.r_[alike, len(keys)]))
        left, right = [np.flatnonzero(crowded)], [pivot[crowded]]
        for off in range(1, SMALL):
            at = np.flatnonzero((keys[off:] == keys[:-off]) & ~crowded[off:])
            left.append(at)
            right.append(at + off)
        left, right = np.concatenate(left), np.concatenate(right)
        fit = (100 * np.minimum(sizes[left], sizes[right]) >= similarity * np.maximum(sizes[left], sizes[right])) & (ids[left] != ids[right])
        a, b = np.minimum(ids[left], ids[right])[fit], np.maximum(ids[left], ids[right])[fit]
        pairs = np.unique(np.stack([a, b], axis=1), axis=0)
        more = int(crowded.sum())
        members = np.repeat(np.add.reduceat(mix(ids.view(np.uint64)), start) if len(keys) else keys, length)  # blocks of the same members count once
        return pd.DataFrame({
            "key": np.r_[np.zeros(len(pairs), np.int64), members[crowded].view(np.int64)],
            "a": np.r_[pairs[:, 0], ids[crowded]],
            "b": np.r_[pairs[:, 1], ids[crowded]],
            "crowded": np.r_[np.zeros(len(pairs), bool), np.ones(more, bool)],
        })

    return run


def verify(pairs: DataFrame, texts: DataFrame, n: int, similarity: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole shingle sets are similar enough; `texts` has (node, sig, _text)."""

    def run(batches):
        for pdf in batches:
            keep, last, one = [], None, None
            for a, x, p, y, q in zip(pdf["a"], pdf["x"], pdf["p"], pdf["y"], pdf["q"]):
                if last != (a, x):
                    last, one = (a, x), distinct(shingles(word_hashes(x), n))
                two = distinct(shingles(word_hashes(y), n))
                both = len(np.intersect1d(one, two, assume_unique=True))
                # an id with several texts gives them all: only the one that its node stands for counts
                keep.append(100 * both >= similarity * (len(one) + len(two) - both) and signature(one) == p and signature(two) == q)
            yield pdf.loc[keep, ["a", "b"]]

    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    # texts of copies compress so well that Spark would take them for small: they are merged at every size, never broadcast
    texts = texts.join(ends, "node", "left_semi")
    wide = pairs.join(texts.select(F.col("node").alias("b"), F.col("_text").alias("y"), F.col("sig").alias("q")).hint("merge"), "b")
    wide = wide.join(texts.select(F.col("node").alias("a"), F.col("_text").alias("x"), F.col("sig").alias("p")).hint("merge"), "a")
    return wide.select("a", "b", "x", "p", "y", "q").mapInPandas(run, "a long, b long")


def _within(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """The pairs within the Hamming bound of their bit sketches."""

    def run(batches):
        for pdf in batches:
            keep = [hamming(p, q) <= most_apart(n, m, similarity) for n, m, p, q in zip(pdf["n"], pdf["m"], pdf["p"], pdf["q"])]
            yield pdf.loc[keep, ["a", "b"]]

    # sketches grow with the documents and compress well, as texts do: merged at every size, never broadcast
    wide = pairs.join(nodes.select(F.col("node").alias("a"), "n", F.col("sketch").alias("p")).hint("merge"), "a")
    wide = wide.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("q")).hint("merge"), "b")
    return wide.select("a", "b", "n", "m", "p", "q").mapInPandas(run, "a long, b long")


def spanning_forest(i: np.ndarray, j: np.ndarray, apart: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) are the shortest that connect the `group`s of their ends: every group takes its nearest, until all are."""
    order = np.argsort(apart, kind="stable")
    label = np.unique(group, return_inverse=True)[1]
    rank, u, v = np.arange(len(order)), label[i[order]], label[j[order]]
    chosen = []
    while True:
        out = u != v
        rank, u, v = rank[out], u[out], v[out]
        if not len(rank):
            return order[np.concatenate(chosen)] if chosen else order[:0]
        nearest = np.full(label.max() + 1, len(order))
        np.minimum.at(nearest, u, rank)
        np.minimum.at(nearest, v, rank)
        best = np.unique(nearest[nearest < len(order)])
        at = np.searchsorted(rank, best)
        chosen.append(best)
        top = np.arange(len(nearest))
        for x, y in zip(u[at].tolist(), v[at].tolist()):
            while top[x] != x:
                x = top[x]
            while top[y] != y:
                y = top[y]
            top[max(x, y)] = min(x, y)
        while (top[top] != top).any():
            top = top[top]
        u, v = top[u], top[v]


def _tiles(similarity: int, everything: bool):
    """From the tile pairs (key, p, q) of one bin: pairs across components within the Hamming bound.

    They are a spanning forest, and a row that says so (more) where others are left, unless `everything` is asked for: then a
    pair that shares several blocks (`keys` of its members) is given by the first of them alone.
    """

    def one_tile(part):
        size = part["sketch"].str.len()
        words = int(size.min()) // 8
        bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, words), axis=0) for s in part["sketch"]])
        n, ids, comp, tile = (part[c].to_numpy() for c in ("n", "node", "component", "tile"))
        key, p, q = (part[c].iat[0] for c in ("key", "p", "q"))
        one, two = np.flatnonzero(tile == p), np.flatnonzero(tile == q)
        step = max(1, 2_000_000 // (max(len(two), 1) * words))
        held, more = (np.zeros(0, np.int64),) * 3, False
        for at in range(0, len(one), step):
            x, y = one[at : at + step, None], two[None, :]
            fit = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]))
            if p == q:
                fit &= x < y
            i, j = np.nonzero(fit)
            i, j = one[at + i], two[j]
            apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1).astype(np.int64)
            near = apart <= (n[i] + n[j]) * (100 - similarity) // (100 + similarity)
            held = tuple(np.concatenate(z) for z in zip(held, (i[near], j[near], apart[near])))
            if not everything and len(held[0]) > 2_000_000:
                best = spanning_forest(*held, comp)
                held, more = tuple(z[best] for z in held), True
        if not everything and len(held[0]):
            best = spanning_forest(*held, comp)
            more |= len(best) < len(held[0])
            held = tuple(z[best] for z in held)
        i, j, _ = held
        if everything and len(i):
            keys = [frozenset(x) for x in part["keys"]]
            first = np.array([min(keys[x] & keys[y]) == key for x, y in zip(i.tolist(), j.tolist())])
            i, j = i[first], j[first]
        yield pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "key": key, "p": p, "q": q, "more": False})
        if more:
            yield pd.DataFrame({"a": [0], "b": [0], "key": [key], "p": [p], "q": [q], "more": [True]})

    def run(pdf):
        return pd.concat([frame for _, part in pdf.groupby(["key", "p", "q"], sort=False) for frame in one_tile(part)])

    return run


def _sketched(rows: DataFrame, nodes: DataFrame, everything: bool) -> DataFrame:
    """`rows` with n and sketch of their node and, if `everything` is asked for, with all its keys; merged, never broadcast."""
    if everything:
        rows = rows.join(rows.groupBy("node").agg(F.collect_set("key").alias("keys")).hint("merge"), "node")
    return rows.join(nodes.select("node", "n", "sketch").hint("merge"), "node")


def _across(rows: DataFrame, nodes: DataFrame, similarity: int, everything: bool, members: int) -> DataFrame:
    """(a, b, key, p, q, more) from the members (key, p, q, tile, node, component) of tile pairs."""
    bins = max(partitions(rows.sparkSession), members // TILE // 4)
    rows = _sketched(rows, nodes, everything).withColumn("bin", F.pmod(F.xxhash64("key", "p", "q"), F.lit(bins)))
    return cut(rows.groupBy("bin").applyInPandas(_tiles(similarity, everything), "a long, b long, key long, p int, q int, more boolean"))


def _crowded_links(crowd: DataFrame, nodes: DataFrame, texts: DataFrame, tested: DataFrame, label: DataFrame, n: int, similarity: int):
    """`label` with the links among the members (key, node) of crowded blocks, and these links (a, b)."""
    found, left, everything, start = None, None, False, True
    while True:
        rows = crowd.join(label.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        sizes = rows.groupBy("key").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        rows = rows.join(sizes.select("key", "members", F.ceil(F.col("members") / TILE).cast("int").alias("tiles")), "key")
        rows = rows.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        if start:  # each member in its largest block, among the members of its own tile
            most = rows.groupBy("node").agg(F.max(F.struct("members", "key")).alias("most")).select("node", F.col("most.key").alias("key"))
            rows = rows.join(most, ["node", "key"]).withColumns({"p": F.col("tile"), "q": F.col("tile")})
        else:
            rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            rows = rows.withColumns({"p": F.least("tile", "other"), "q": F.greatest("tile", "other")})
        rows = rows.select("key", "p", "q", "tile", "node", "component")
        rows = cut(rows.join(left, ["key", "p", "q"], "left_semi") if left is not None else rows)
        members = rows.count()
        if not members and not start:
            return label, found
        met = _across(rows, nodes, similarity, everything, members)
        pairs = cut(met.where("not more").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        new = cut(verify(pairs, texts, n, similarity))
        tested, found = tested.unionByName(pairs), found.unionByName(new) if found is not None else new
        if everything:
            return merged(label, new), found
        if not start:
            left = cut(met.where("more").select("key", "p", "q").distinct())
            everything = not new.limit(1).count()  # the nearest lead no further: look at all that are left
        start = False
        label = merged(label, new)


def similar_links(docs: DataFrame, n: int = 5, similarity: int = 75, id_col: str = "doc_id", text_col: str = "text"):
    """(named, links, label): (_id, n, node) for every document with an id, verified links (a, b) between nodes, and (id,
    component) for the nodes that have links.

    A node is a distinct shingle set.  The links join every two nodes of one component, though not always directly.
    """
    spark = docs.sparkSession
    slim = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    passed = cut(shingle_sets(slim, n))
    common = spark.sparkContext.broadcast(commonness(passed.where("chunk >= 0")))
    sets = passed.where("chunk < 0")
    total = sets.agg(F.sum("n")).first()[0] or 0
    shards = max(partitions(spark), total // WORDS_PER_SHARD)
    firsts = sets.where("n > 0").groupBy("sig").agg(F.min("row").alias("node"))
    named = cut(sets.join(firsts, "sig", "left").select("_id", "n", "node", "sig", "s0", F.when(F.col("row") == F.col("node"), F.col("sketch")).alias("sketch")))
    nodes = named.where("sketch is not null").select("node", "n", "sig", "s0", "sketch", F.col("_id").alias("rep"))

    met = cut(_send(slim, n, similarity, shards, common).groupBy("shard").applyInPandas(_meet(similarity), "key long, a long, b long, crowded boolean"))
    node_of = nodes.select("s0", "node")  # sets that agree in s0 all become candidates
    pairs = met.where("not crowded").select("a", "b").distinct()
    pairs = pairs.join(node_of.select(F.col("s0").alias("a"), F.col("node").alias("na")), "a").join(node_of.select(F.col("s0").alias("b"), F.col("node").alias("nb")), "b")
    pairs = cut(_within(pairs.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), nodes, similarity))
    crowd = cut(met.where("crowded").select("key", F.col("a").alias("s0")).distinct().join(node_of, "s0").select("key", "node"))
    used = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(crowd.select("node")).distinct()
    nodes = cut(nodes.join(used, "node", "left_semi").select("node", "n", "sig", "sketch", "rep"))
    # nodes grow with the documents: merged with them at every size, never broadcast
    texts = cut(slim.join(nodes.select("node", "sig", F.col("rep").alias("_id")).hint("merge"), "_id").select("node", "sig", "_text"))

    links = cut(verify(pairs, texts, n, similarity))
    label, more = _crowded_links(crowd, nodes, texts, pairs, components(links), n, similarity)
    return named, links.unionByName(more), label


def similar_components(docs: DataFrame, n: int = 5, similarity: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, n_verified, component_id) for every row; n_verified counts the links of its set that were verified."""
    named, links, label = similar_links(docs, n, similarity, id_col, text_col)
    ends = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_verified"))
    rows = named.join(label.withColumnRenamed("id", "node"), "node", "left").join(ends, "node", "left")
    rows = cut(rows.select("_id", "n", F.coalesce("component", "node").alias("component"), F.coalesce("n_verified", F.lit(0)).alias("n_verified")))
    # an id with several texts joins their components
    several = rows.where("component is not null").groupBy("_id").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    several = rows.join(several, "_id").select("a", F.col("component").alias("b")).distinct()
    top = components(several).select(F.col("id").alias("component"), F.col("component").alias("top"))
    rows = rows.join(top, "component", "left").withColumn("component", F.coalesce("top", "component"))
    smallest = rows.where("component is not null").groupBy("component").agg(F.min("_id").alias("component_id"))
    out = rows.join(smallest, "component", "left").groupBy("_id").agg(F.max("n").alias("n_shingles"), F.max("n_verified").alias("n_verified"), F.min(F.coalesce("component_id", "_id")).alias("component_id"))
    return docs.select(F.col(id_col).cast("long").alias(id_col)).join(out.withColumnRenamed("_id", id_col), id_col, "left")


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return similar_components(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op6_ngram_join": op6_ngram_join}
ORACLE_SQL = {
    "op6_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') AS g
  FROM words, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
reach AS (
  SELECT a AS doc_id, b AS other FROM links
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN reach r USING (doc_id)
GROUP BY d.doc_id, s.n
"""
}
