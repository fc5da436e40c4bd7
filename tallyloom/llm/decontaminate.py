"""Benchmark decontamination by winnowing, in DataFrame functions alone.

1. Every text becomes an array of words, every run of k words a hash, and of each w neighbouring hashes the smallest is
   kept, with its position.  A span of k + w - 1 = 13 words that a document shares with an item therefore leaves at least
   one fingerprint in both.  Items shorter than 13 words are whole windows; they fall into length classes with smaller k
   and w, of which only those that occur are computed.
2. Fingerprints of documents are joined with the distinct fingerprints of the items.
3. Each hit is extended to all windows around it, and these are joined with the items' windows, word by word.
4. Hit windows are merged into covered words by document.
5. Windows that the same items hold share one key, made of sums over the items' hashes, so no window carries a list of items:
   the distinct keys of a document are joined with the items of each key.

The items' side is broadcast only if it has at most BROADCAST_ROWS rows; else both joins shuffle on fingerprint and window,
where adaptive execution splits a hot one.  Positions are kept in 24 bits beside 40 bits of hash; a longer text gives each
hit all its possible positions, and the exact join drops the false ones.

Defined cases: null and word-less texts have no words and no hits; a null id is an id; rows repeating an id are judged row
by row; items without words never match; an item without an id hits words but is in no list of items; further columns of the documents are left out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
BROADCAST_ROWS = 200_000
POSITION_BITS = 24
LOW = (1 << POSITION_BITS) - 1
#: (shortest length, longest length, words in a hash): the shortest shared span always leaves a fingerprint.
CLASSES = ((1, 3, 1), (4, 7, 3), (8, 12, 5), (WINDOW, WINDOW, 6))


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; an empty array for a null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """`body` over a value that is computed once a row; a plain reference inside a lambda would compute it once an element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fingerprints(hashes: Column, shortest: int, k: int) -> Column:
    """Winnowed fingerprints of an array of word hashes: 40 bits of hash above 24 bits of position."""
    w = shortest - k + 1
    size = F.size(hashes)

    def gram(i):
        return F.xxhash64(F.lit(shortest), *[F.get(hashes, i + j) for j in range(k)]).bitwiseAND(F.lit(~LOW)).bitwiseOR(i.bitwiseAND(F.lit(LOW)).cast("long"))

    def chosen(grams):
        if w == 1:
            return grams
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(grams) - w), lambda i: F.least(*[F.get(grams, i + j) for j in range(w)])))

    grams = F.transform(F.sequence(F.lit(0), size - k), gram)
    return F.when(size >= shortest, bind(grams, chosen)).otherwise(F.array().cast("array<bigint>"))


def _marked(df: DataFrame, classes, *keep: str) -> DataFrame:
    """`keep`, n_words and a column f<shortest> of fingerprints for each class; `df` has _text."""
    made = bind(
        F.transform(words(F.col("_text")), lambda w: F.xxhash64(w)),
        lambda h: F.struct(F.size(h).alias("n_words"), *[fingerprints(h, a, k).alias(f"f{a}") for a, _, k in classes]),
    )
    return df.select(*keep, made.alias("_made")).select(*keep, "_made.*")


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast, if a count proves the bound."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row a document: its id, n_words, n_hit, and `items`, the sorted ids (as strings) of the items with windows in it."""
    items = bench.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("_text"))
    windows = items.select("item", words(F.col("_text")).alias("w")).select(
        "item",
        F.explode(bind(F.col("w"), lambda w: F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.struct(F.lit(WINDOW).alias("len"), F.array_join(F.slice(w, i, WINDOW), " ").alias("win")))).otherwise(F.filter(F.array(F.struct(F.size(w).alias("len"), F.array_join(w, " ").alias("win"))), lambda x: x["len"] > 0)))).alias("x"),
    )
    held = cut(windows.select("x.len", "x.win", "item").distinct())
    h = F.xxhash64("item")
    windows = cut(held.groupBy("len", "win").agg(F.struct(F.count("item").alias("n"), F.bit_xor(h).alias("a"), F.sum(F.xxhash64(h, F.lit(1)).bitwiseAND(F.lit(0xFFFFFFFF))).alias("b")).alias("held_by")))
    # one window stands for all that the same items hold
    lists = windows.groupBy("held_by").agg(F.min(F.struct("len", "win")).alias("x")).select("held_by", "x.*")
    lists = held.where(F.col("item").isNotNull()).join(lists, ["len", "win"]).select("held_by", "item")
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most WINDOW numbers
    classes = [c for c in CLASSES if any(c[0] <= n <= c[1] for n in lengths)]

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    if not classes:
        return slim.select(F.col("_id").alias(id_col), F.size(words(F.col("_text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    of_docs = cut(_marked(slim, classes, "_id", "_h"))
    of_items = _marked(items, classes, "item").where(F.col("n_words") > 0)

    hits = []
    for shortest, longest, k in classes:
        own = of_items.where(F.col("n_words").between(shortest, longest if shortest < WINDOW else 2**31 - 1))
        own = own.select(F.explode(f"f{shortest}").alias("mark")).select(F.shiftright("mark", POSITION_BITS).alias("print")).distinct()
        seen = of_docs.select("_id", "_h", F.explode(f"f{shortest}").alias("mark"))
        seen = seen.select("_id", "_h", F.col("mark").bitwiseAND(F.lit(LOW)).cast("int").alias("at"), F.shiftright("mark", POSITION_BITS).alias("print"))
        hits.append(seen.join(_bounded(own), "print").select("_id", "_h", F.struct(F.lit(shortest).alias("cls"), "at").alias("hit")))
    hit = hits[0]
    for more in hits[1:]:
        hit = hit.unionByName(more)
    hit = hit.groupBy("_id", "_h").agg(F.collect_set("hit").alias("hits"))

    def around(w, hit_list):
        """(len, start) of every window of the items' lengths that holds a hit."""
        def starts(length, shortest, k):
            places = F.flatten(F.transform(F.filter(hit_list, lambda h: h["cls"] == shortest), lambda h: F.sequence(h["at"], F.greatest(F.size(w) - 1, h["at"]), F.lit(LOW + 1))))
            spans = F.filter(F.transform(places, lambda p: F.struct(F.greatest(p + k - length, F.lit(0)).alias("a"), F.least(p, F.size(w) - length).alias("b"))), lambda s: s["a"] <= s["b"])
            return F.transform(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["a"], s["b"])))), lambda s: F.struct(F.lit(length).alias("len"), s.alias("at"), F.array_join(F.slice(w, s + 1, length), " ").alias("win")))

        return F.concat(*[starts(n, a, k) for a, b, k in classes for n in lengths if a <= n <= b])

    near = slim.join(hit.withColumnsRenamed({"_id": "_i", "_h": "_g"}), F.col("_id").eqNullSafe(F.col("_i")) & F.col("_h").eqNullSafe(F.col("_g")))
    near = near.select("_id", "_h", F.explode(bind(F.struct(words(F.col("_text")).alias("w"), F.col("hits").alias("hits")), lambda s: around(s["w"], s["hits"]))).alias("x")).select("_id", "_h", "x.*")
    met = cut(near.join(_bounded(windows), ["len", "win"]).select("_id", "_h", "at", "len", "held_by"))
    found = met.groupBy("_id", "_h").agg(F.array_sort(F.collect_set(F.struct("at", "len"))).alias("spans"))
    listed = met.select("_id", "_h", "held_by").distinct().join(_bounded(lists), "held_by").groupBy("_id", "_h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(s["at"] + s["len"] - F.greatest(acc["end"], s["at"]), F.lit(0))).alias("n"), F.greatest(acc["end"], s["at"] + s["len"]).alias("end")),
        lambda acc: acc["n"],
    )
    found = found.select(F.col("_id").alias("_i"), F.col("_h").alias("_g"), covered.alias("n_hit"))
    listed = listed.withColumnsRenamed({"_id": "_k", "_h": "_l"})
    found = found.join(listed, F.col("_i").eqNullSafe(F.col("_k")) & F.col("_g").eqNullSafe(F.col("_l")), "left")
    out = of_docs.select("_id", "_h", "n_words").join(found, F.col("_id").eqNullSafe(F.col("_i")) & F.col("_h").eqNullSafe(F.col("_g")), "left")
    return out.select(F.col("_id").alias(id_col), F.col("n_words").cast("long"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLE_SQL = {
    "op1_decontaminate": r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n,
         array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
  FROM item_words, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS r(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i AS pos, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM doc_words, lens, unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n),
hits AS (SELECT doc_id, pos, n, item_id FROM doc_windows JOIN item_windows USING (n, win)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(pos, pos + n)) AS r(p) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
}
