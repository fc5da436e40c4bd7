"""Exact top-k by inner product over an impact-ordered index, score at a time.

* Rows are dealt by a hash into blocks.  A block keeps, for each dimension, its postings (row, value) in order of falling
  |value|, cut into segments of equal quantised impact (LEVELS steps of |value|).  The index is a table of such blocks: their
  postings are ordered once, when it is built, and any number of searches read it.
* A query takes the segments of all dimensions in order of falling |query value| * step, in waves, and adds each posting's
  exact contribution to its row's accumulator.  A row's score then differs from its accumulator by at most `slack`, the sum over
  dimensions of |query value| * (the largest value not yet taken).  Rows that are more than 2 * slack below the k-th
  accumulator are proven out.  Once few rows are left, or nothing is, the possible members are scored exactly.
* Queries come in blocks, too.  Blocks meet as cogroups of one row each, so a task holds one block of rows and
  one of queries at a time, and returns k rows a query; the k best of all blocks are merged by query.

Defined cases: vectors that are null or hold null or non-finite components, and null ids, take no part; shorter vectors count
as padded with zeros, longer queries than the index's rows as cut to their length; rows with the query's own id are not its candidates; repeated rows are candidates each, repeated
queries count once; ties go to the smaller id; a query with fewer than k candidates has them all; an empty table has no
results; further columns are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

BLOCK_ROWS = 8192
BLOCK_QUERIES = 2048
LEVELS = 16
#: Once the proof leaves a row in RESCORED, these are scored exactly.
RESCORED = 8
#: Shares of the segments after which the proof is tried; the segments between two tries are added in one pass.
TRIES = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


#: A block of the index as a row: ids and rows, and by dimension the order of the postings, cuts and edges of its segments.
INDEX = "block int, dims int, ids binary, rows binary, postings binary, cuts binary, edges binary"


class ImpactBlock:
    def __init__(self, ids: np.ndarray, rows: np.ndarray, stored: tuple | None = None):
        """rows: one integer vector a row; stored: postings, cuts and edges, if they have been made before."""
        self.ids, self.rows = ids, rows
        order, self.cuts, self.edges = stored or self._ordered(rows)
        self.order = order.astype(np.intp)
        self.values = np.take_along_axis(rows.T, self.order, axis=1)

    @staticmethod
    def _ordered(rows: np.ndarray) -> tuple:
        n, dims = rows.shape
        size = np.abs(rows)
        order = np.argsort(-size, axis=0, kind="stable").T.astype(np.int32)  # dims x n
        step = np.maximum(-(-size.max(axis=0, initial=0) // LEVELS), 1)
        edges = step[:, None] * np.arange(LEVELS, -1, -1)  # falling; the last is zero
        falling = np.take_along_axis(size.T, order.astype(np.int64), axis=1)
        cuts = np.stack([np.searchsorted(-falling[d], -edges[d], side="right") for d in range(dims)]) if dims else np.zeros((0, LEVELS + 1), np.int64)
        cuts[:, 0], cuts[:, -1] = 0, n  # the largest value may equal the first edge
        return order, cuts, edges

    def stored(self) -> dict:
        n, dims = self.rows.shape
        return {"dims": dims, "ids": self.ids.tobytes(), "rows": self.rows.tobytes(), "postings": self.order.astype(np.int32).tobytes(), "cuts": self.cuts.astype(np.int64).tobytes(), "edges": self.edges.astype(np.int64).tobytes()}

    @classmethod
    def read(cls, row) -> "ImpactBlock":
        dims = int(row["dims"])
        ids = np.frombuffer(row["ids"], np.int64)
        levels = [np.frombuffer(row[c], np.int64).reshape(dims, LEVELS + 1) for c in ("cuts", "edges")]
        return cls(ids, np.frombuffer(row["rows"], np.int64).reshape(len(ids), dims), (np.frombuffer(row["postings"], np.int32).reshape(dims, len(ids)), *levels))

    def _added(self, query: np.ndarray, done: np.ndarray, upto: np.ndarray, exact: bool) -> np.ndarray:
        """What the segments from `done` to `upto` of each dimension add to each row's accumulator."""
        slices = [(d, slice(self.cuts[d, done[d]], self.cuts[d, upto[d]])) for d in np.flatnonzero(upto > done)]
        if not slices:
            return np.zeros(len(self.ids), np.int64)
        at = np.concatenate([self.order[d, s] for d, s in slices])
        if exact:  # doubles hold these sums exactly
            return np.bincount(at, np.concatenate([self.values[d, s] * float(query[d]) for d, s in slices]), len(self.ids)).astype(np.int64)
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, at, np.concatenate([self.values[d, s] * query[d] for d, s in slices]))
        return out

    def search(self, own: int, query: np.ndarray, k: int):
        """(ids, scores) of the k best rows other than `own`."""
        weight = np.abs(query)
        impact = weight[:, None] * self.edges[:, :-1]
        order = np.sort(impact[impact > 0])[::-1]
        exact = int((weight * self.edges[:, 0]).sum()) < 1 << 52
        done = np.zeros(len(query), np.int64)
        total = np.zeros(len(self.ids), np.int64)
        out = self.ids == own
        low = int(-np.iinfo(np.int64).max // 4)
        possible = None
        for share in (*TRIES, 1.0) if len(order) else ():
            # impacts fall along a dimension, so the segments of at least the wave's last impact are its first ones
            upto = (impact >= order[max(int(len(order) * share) - 1, 0)]).sum(axis=1)
            total += self._added(query, done, upto, exact)
            done = upto
            if share < 1 and len(total) > k:
                slack = int((weight * self.edges[np.arange(len(query)), done]).sum())
                seen = np.where(out, low, total)
                kth = np.partition(seen, len(seen) - k)[len(seen) - k]
                possible = np.flatnonzero(seen >= kth - 2 * slack)
                if len(possible) <= max(8 * k, len(total) // RESCORED):
                    break
                possible = None
        if possible is None:
            possible = np.flatnonzero(~out)
            if len(possible) > k:
                seen = total[possible]
                possible = possible[seen >= np.partition(seen, len(seen) - k)[len(seen) - k]]
        possible = possible[~out[possible]]
        scores = self.rows[possible] @ query
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return self.ids[possible[best]], scores[best]


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(_id, _v): finite vectors with each component turned into floor(scale * x)."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    fit = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(whole, F.lit(False)))
    return fit.select(F.col(id_col).cast("long").alias("_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("_v"))


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    m = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v[:dims]
    return m


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, path: str | None = None) -> DataFrame:
    """The index of all rows, one row a block (see INDEX): written to `path`, else to the shared checkpoint folder."""
    rows = quantised(vectors, id_col, vector_col, scale)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("_v")).alias("dims")).first()
    dims, blocks = max(size["dims"] or 0, 1), max(1, -(-size["n"] // BLOCK_ROWS))

    def run(key, pdf):
        block = ImpactBlock(pdf["_id"].to_numpy(np.int64), _matrix(pdf["_v"], dims))
        return pd.DataFrame([{"block": key[0], **block.stored()}])

    made = rows.withColumn("block", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(run, INDEX)
    if path is None:
        return cut(made)
    made.write.parquet(path)
    return vectors.sparkSession.read.schema(made.schema).parquet(path)


def search(index: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, id, score): the k best rows of the index for each row of `queries`, but for rows of its own id."""
    asked = quantised(queries, id_col, vector_col, scale).dropDuplicates(["_id"])
    size = index.agg(F.max("dims").alias("dims"), F.max("block").alias("last")).first()
    dims, blocks = size["dims"] or 1, (size["last"] if size["last"] is not None else -1) + 1
    spans = max(1, -(-asked.count() // BLOCK_QUERIES))

    def pack(key, pdf):
        return pd.DataFrame([{"q": key[0], "q_ids": pdf["_id"].to_numpy(np.int64).tobytes(), "q_rows": _matrix(pdf["_v"], dims).tobytes()}])

    asked = cut(asked.withColumn("q", F.pmod(F.xxhash64("_id"), F.lit(spans)).cast("int")).groupBy("q").applyInPandas(pack, "q int, q_ids binary, q_rows binary"))
    # the smaller side, of queries, is copied to each block of rows, the index only once for each BLOCK_QUERIES queries
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks else F.lit(0))
    index = index.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))))

    def run(key, own, other):
        found = []
        if len(own) and len(other):
            block, q = ImpactBlock.read(own.iloc[0]), other.iloc[0]
            for query_id, v in zip(np.frombuffer(q["q_ids"], np.int64), np.frombuffer(q["q_rows"], np.int64).reshape(-1, dims)):
                ids, scores = block.search(int(query_id), v, k)
                found.append((np.full(len(ids), query_id), ids, scores))
        parts = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else [()] * 3)]
        return pd.DataFrame(dict(zip(("query_id", "_id", "score"), parts)))

    found = index.groupBy("block", "q").cogroup(asked.groupBy("block", "q")).applyInPandas(run, "query_id long, _id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("_id").alias(id_col), "score")


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, id, score) for each row that meets `queries`, against all other rows."""
    return search(build_index(vectors, id_col, vector_col, scale), vectors.where(queries), k, id_col, vector_col, scale)


def op10_topk(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op10_topk": op10_topk}
ORACLE_SQL = {
    "op10_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
}
