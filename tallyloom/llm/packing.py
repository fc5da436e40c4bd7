"""Packing into optimal length buckets.

1. Texts are measured in tokens and cut into pieces of at most `context` tokens.
2. A global histogram counts pieces by length: at most `context` rows, whatever the input.
3. Dynamic programming over that histogram picks the `buckets` upper bounds with the least padding in all, when every piece
   is padded to its bucket's bound.  The cost has the quadrangle inequality, so each layer is solved by divide and conquer.
4. Inside a bucket pieces are numbered without a gap: rows are dealt to shards by a number drawn for each row and stored with
   it, numbered within their shard, and shifted by the shard's offset, so no bucket is ever sorted in one task, whatever the ids.  floor(budget / bound) neighbours form a batch,
   and only the last batch of a bucket can be short.

Defined cases: a null or empty text has no words and makes one piece that is just the end token; rows are packed as they
are, repeated or not; a null id is an id; the documents' further columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, partitions

CONTEXT = 4096
BUDGET = 65_536
BUCKETS = 16
ROWS_PER_SHARD = 50_000
SEED = 11


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds, ascending, that minimise sum(count * (bound - length)); the last is the longest length."""
    n = len(lengths)
    if not n:
        return []
    order = np.argsort(lengths)
    x, c = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total, weighted = np.r_[0, np.cumsum(c)], np.r_[0, np.cumsum(c * x)]

    def cost(i, j):  # lengths i..j-1 padded to x[j-1]
        return x[j - 1] * (total[j] - total[i]) - (weighted[j] - weighted[i])

    best = np.r_[0, [cost(0, j) for j in range(1, n + 1)]]
    choice = [np.zeros(n + 1, np.int64)]
    for _ in range(min(buckets, n) - 1):
        new, cut_at = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            values = best[i] + cost(i, mid)
            k = int(np.argmin(values))
            new[mid], cut_at[mid] = values[k], i[k]
            todo += [(lo, mid - 1, a, int(i[k])), (mid + 1, hi, int(i[k]), b)]
        best = new
        choice.append(cut_at)
    bounds, j = [], n
    for layer in reversed(choice):
        if j == 0:
            break
        bounds.append(int(x[j - 1]))
        j = int(layer[j])
    return sorted(set(bounds))


def word_tokens(text: Column) -> Column:
    """Words between ASCII white space, and one end token."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(1)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")) + 1)


def pack(docs: DataFrame, tokens: Column, id_col: str = "doc_id", context: int = CONTEXT, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """(id, piece, start, n_tokens, bucket, bound, batch, slot): one row a piece of at most `context` tokens."""
    if budget < context:
        raise ValueError("a batch must hold a piece of the full context")
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("_id"), tokens.cast("long").alias("_n"))
    pieces = sized.select("_id", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / context))).alias("piece"))
    pieces = cut(pieces.select("_id", "piece", (F.col("piece") * context).alias("start"), F.least(F.col("_n") - F.col("piece") * context, F.lit(context)).cast("int").alias("n_tokens"), F.floor(F.rand(SEED) * (1 << 30)).cast("int").alias("salt")))
    histogram = pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()  # at most `context` rows
    bounds = best_bounds(np.array([r["n_tokens"] for r in histogram]), np.array([r["n"] for r in histogram]), buckets)
    total = sum(r["n"] for r in histogram)
    shards = max(4 * partitions(spark), total // ROWS_PER_SHARD)

    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<int>"), lambda b: b < F.col("n_tokens")))
    dealt = pieces.withColumn("bucket", bucket).withColumn("shard", F.pmod(F.xxhash64("salt", "_id", "piece"), F.lit(shards)).cast("int"))
    sizes = dealt.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    offsets = sizes.select("bucket", "shard", (F.sum("n").over(W.partitionBy("bucket").orderBy("shard")) - F.col("n")).alias("offset"))
    numbered = dealt.withColumn("nth", F.row_number().over(W.partitionBy("bucket", "shard").orderBy("_id", "piece", "n_tokens")) - 1)
    out = numbered.join(offsets, ["bucket", "shard"]).withColumn("bound", F.element_at(F.array(*[F.lit(b) for b in bounds or [0]]), F.col("bucket") + 1))
    nth, room = F.col("offset") + F.col("nth"), F.floor(F.lit(budget) / F.col("bound"))
    return out.select(F.col("_id").alias(id_col), "piece", "start", "n_tokens", "bucket", "bound", F.floor(nth / room).alias("batch"), F.pmod(nth, room).alias("slot"))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return pack(table(spark, sf_dir, "documents"), word_tokens(F.col("text")))


QUERIES = {"op2_packing": op2_packing}
ORACLE_SQL: dict[str, str] = {}
