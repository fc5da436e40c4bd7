"""Line dedup through a sharded minimal perfect hash.

1. Tasks hash the distinct line keys of their documents, merge them with a local sort and send packed arrays to shards of
   the hash space, so a line that a third of all documents hold reaches its shard once a task, not once a document.
2. Each shard numbers its distinct keys with a minimal perfect hash and lays out arrays by that number: a 16-bit
   fingerprint, a count, and for repeated keys the smallest document.  The index is checkpointed.
3. Documents probe these arrays: probes travel, packed, to the shard that holds their part of the index, and what comes
   back is, for each document, the keys it loses.  A key that `heavy_from` documents or more hold would fill its shard with
   probes: such keys alone go to the tasks by a broadcast.  There are fewer than HEAVY of them, as `heavy_from` is raised to
   1/HEAVY of all lines where that is more.
4. Documents are joined with what they lose and rewritten.

Defined cases: a null or empty text is one empty line; a null id takes no part and loses nothing; rows that repeat an id
are one document; further columns pass through, whatever their names, but `text`, `n_lines` and `n_dropped` of the input
are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, joined, partitions, split_by
from .perfect_hash import PerfectHash, build

SPACE = b" \t\n\v\f\r"
#: Most keys that are broadcast.
HEAVY = 20_000
LINES_PER_SHARD = 100_000
#: Documents that hold a key from which on it is broadcast: as many probes as a shard has lines.
HEAVY_FROM = 100_000
#: Stands for a null id inside pandas, which would turn a column with nulls into floats.
NO_ID = -(2**63)
FLUSH = 1_000_000


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The 16-byte digest of each line's key; None where the key is too short to count."""
    import xxhash

    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(SPACE).lower()
        n = len(key)
        if n < min_chars or n < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars:
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key))
    return out


def _flushes(batches, min_chars: int, skip=frozenset()):
    """(keys, ids) of the distinct keys of whole documents, a million or so at a time."""
    keys: list[bytes] = []
    ids: list[int] = []
    sizes: list[int] = []
    for pdf in batches:
        for i, text in zip(pdf["_id"], pdf["_text"]):
            own = set(line_keys(text, min_chars)) - {None}
            if skip:
                own = own.difference(skip)
            keys.extend(own)
            ids.append(i)
            sizes.append(len(own))
            if len(keys) >= FLUSH:
                yield np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2), np.repeat(np.array(ids, np.int64), sizes)
                keys, ids, sizes = [], [], []
    if keys:
        yield np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2), np.repeat(np.array(ids, np.int64), sizes)


def _merge(keys: np.ndarray, first: np.ndarray, last: np.ndarray, count: np.ndarray):
    """Distinct keys with the smallest first, the largest last and the sum of counts."""
    if not len(keys):
        return keys, first, last, count
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys, first, last, count = keys[order], first[order], last[order], count[order]
    start = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1]
    return keys[start], np.minimum.reduceat(first, start), np.maximum.reduceat(last, start), np.add.reduceat(count, start)


def line_index(docs: DataFrame, shards: int, heavy_from: int, min_chars: int) -> DataFrame:
    """The index: one row a shard.  `docs` has _id and _text."""

    def send(batches):
        for keys, ids in _flushes(batches, min_chars):
            keys, first, last, count = _merge(keys, ids, ids, np.ones(len(ids), np.int64))
            shard = (keys[:, 0] >> np.uint64(32)).astype(np.int64) * shards >> 32
            rows = [(s, k.tobytes(), a.tobytes(), b.tobytes(), c.tobytes()) for s, (k, a, b, c) in split_by(shard, keys, first, last, count)]
            yield pd.DataFrame(rows, columns=["shard", "keys", "first", "last", "count"])

    def lay_out(key, pdf):
        keys, first, last, count = _merge(joined(pdf["keys"], np.uint64).reshape(-1, 2), joined(pdf["first"], np.int64), joined(pdf["last"], np.int64), joined(pdf["count"], np.int64))
        data = build(keys)
        place = PerfectHash(data)(keys)
        n = len(keys)
        prints, counts, firsts = np.zeros(n, np.uint16), np.zeros(n, np.uint32), np.zeros(n, np.int64)
        prints[place] = keys[:, 1].astype(np.uint16)
        counts[place] = np.where(first < last, np.minimum(np.maximum(count, 2), 2**32 - 1), 1)
        firsts[place] = first
        heavy = (count >= heavy_from) & (first < last)
        return pd.DataFrame({"shard": [key[0]], "mph": [data], "prints": [prints.tobytes()], "counts": [counts.tobytes()], "firsts": [firsts[counts > 1].tobytes()], "heavy_keys": [keys[heavy].tobytes()], "heavy_firsts": [first[heavy].tobytes()]})

    sent = docs.mapInPandas(send, "shard int, keys binary, first binary, last binary, count binary")
    return sent.groupBy("shard").applyInPandas(lay_out, "shard int, mph binary, prints binary, counts binary, firsts binary, heavy_keys binary, heavy_firsts binary")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, heavy_from: int = HEAVY_FROM) -> DataFrame:
    """`docs` with repeated lines gone from all but the smallest document, and n_lines and n_dropped."""
    spark = docs.sparkSession
    slim = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    text = F.coalesce("_text", F.lit(""))
    lines = slim.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    shards = max(partitions(spark), -(-lines // LINES_PER_SHARD))
    heavy_from = max(2, heavy_from, lines // HEAVY + 1)
    index = cut(line_index(slim, shards, heavy_from, min_chars))
    heavy: dict[bytes, int] = {}
    for row in index.where(F.length("heavy_keys") > 0).select("heavy_keys", "heavy_firsts").toLocalIterator():
        keys = bytes(row["heavy_keys"])
        heavy.update(zip((keys[i : i + 16] for i in range(0, len(keys), 16)), np.frombuffer(row["heavy_firsts"], np.int64).tolist()))
    shared = spark.sparkContext.broadcast(heavy)

    def send(batches):
        for keys, ids in _flushes(batches, min_chars, shared.value.keys()):
            shard = (keys[:, 0] >> np.uint64(32)).astype(np.int64) * shards >> 32
            yield pd.DataFrame([(s, k.tobytes(), i.tobytes()) for s, (k, i) in split_by(shard, keys, ids)], columns=["shard", "keys", "ids"])

    def probe(key, probes, part):
        rows = []
        if len(probes) and len(part):
            part = part.iloc[0]
            place_of = PerfectHash(part["mph"])
            prints, counts = np.frombuffer(part["prints"], np.uint16), np.frombuffer(part["counts"], np.uint32)
            firsts = np.full(len(counts), -1, np.int64)
            firsts[counts > 1] = np.frombuffer(part["firsts"], np.int64)
            for packed, who in zip(probes["keys"], probes["ids"]):
                keys, ids = np.frombuffer(packed, np.uint64).reshape(-1, 2), np.frombuffer(who, np.int64)
                place = place_of(keys)
                lost = (place >= 0) & (prints[place] == keys[:, 1].astype(np.uint16)) & (counts[place] > 1) & (firsts[place] != ids)
                rows += [(i, k.tobytes()) for i, (k,) in split_by(ids[lost], keys[lost])]
        return pd.DataFrame(rows, columns=["_id", "lost"]).astype({"_id": "int64"})

    sent = slim.mapInPandas(send, "shard int, keys binary, ids binary")
    lost = sent.groupBy("shard").cogroup(index.select("shard", "mph", "prints", "counts", "firsts").groupBy("shard")).applyInPandas(probe, "_id long, lost binary")
    lost = lost.groupBy("_id").agg(F.collect_list("lost").alias("_lost"))

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def rewrite(ids: pd.Series, texts: pd.Series, losses: pd.Series) -> pd.DataFrame:
        kept, n_lines, n_dropped = [], [], []
        for i, text, loss in zip(ids, texts, losses):
            text = text or ""
            gone = set() if loss is None else {b[k : k + 16] for b in map(bytes, loss) for k in range(0, len(b), 16)}
            keys = line_keys(text, min_chars) if i != NO_ID else []
            if i != NO_ID:
                gone.update(k for k in keys if k in shared.value and shared.value[k] != i)
            old = text.split("\n")
            new = [x for x, k in zip(old, keys) if k is None or k not in gone] if gone else old
            kept.append("\n".join(new))
            n_lines.append(len(old))
            n_dropped.append(len(old) - len(new))
        return pd.DataFrame({"text": kept, "n_lines": n_lines, "n_dropped": n_dropped})

    out = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("_id")).join(lost, "_id", "left")
    out = out.withColumn("_new", rewrite(F.coalesce("_id", F.lit(NO_ID)), F.col(f"_row.{text_col}"), "_lost"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*[F.col("_new.text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in own], "_new.n_lines", "_new.n_dropped")


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLE_SQL = {
    "op5_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
seen AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.first_doc AS dropped FROM keyed k LEFT JOIN seen s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
}
