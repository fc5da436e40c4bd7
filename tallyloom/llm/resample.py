"""Importance resampling towards a target distribution over hashed n-gram features.

1. Every run of 1 to 3 words is a feature, hashed into BUCKETS buckets by the crc32 of its bytes.  Tasks count buckets in
   arrays; their sums over the raw and the target table give one gain a bucket, an array of BUCKETS integers.
2. A second pass over the texts scores documents with that array: weight is the sum of the gains of its features, and the
   score adds Gumbel noise drawn from the id, so the highest scores are a sample without replacement, the same in every run.
3. Ranks come from parallel sorting by regular sampling.  Each task sorts its rows (a run) and keeps samples at regular
   places; the samples of all runs give regular splitters; rows are dealt to segments between splitters, segments are
   merged locally, and prefix counts of the segments turn places inside a segment into ranks.  Segments beyond the last
   drawn rank are counted but never exchanged.

The driver sees BUCKETS sums, at most 2 * SEGMENTS samples a run, and a count a segment.  Runs are narrow rows, so there is one
for some millions of documents.  A row number completes the sort key, so repeated ids with equal scores split like any rows.

The crc of a feature is put together from those of its words: appending L bytes to a text shifts its crc by a fixed linear
map of L, kept as four tables of 256 entries for each L.

Defined cases: null, empty and word-less texts have no features and weight 0; a document below `least_words` is scored but
never drawn; a null id hashes as the empty string and comes after all others in ties; repeated rows are rows; an empty target or
raw table gives the gains of its zero counts; further columns are left out.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, partitions

BUCKETS = 10_000
LONGEST_RUN = 3
SEGMENTS = 1_000
#: Bytes of text that a task takes apart at a time.
PORTION = 4 << 20
#: Words that a worker remembers before it starts anew.
REMEMBERED = 1 << 20


def _separated() -> bytes:
    """For bytes.translate: letters, digits and non-ASCII bytes stay, A-Z lower-cased; all else becomes a space."""
    to = bytearray(b" " * 128) + bytearray(range(128, 256))
    for c in b"0123456789abcdefghijklmnopqrstuvwxyz":
        to[c] = c
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        to[c] = c + 32
    return bytes(to)


class Shift:
    """The crc32 of a text after `length` further bytes, up to the crc32 of these bytes, for arrays of crcs and lengths."""

    def __init__(self, longest: int = 64):
        byte = np.arange(256, dtype=np.uint32)
        step = byte.copy()
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
        table = [np.stack([byte << np.uint32(8 * k) for k in range(4)])]
        for _ in range(longest):
            table.append((table[-1] >> np.uint32(8)) ^ step[table[-1] & 255])
        self.longest, self.table = longest, np.concatenate([t.ravel() for t in table])

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        out, left = crc.copy(), length.astype(np.int64)
        todo = np.arange(len(out))
        while len(todo):
            by = np.minimum(left[todo], self.longest)
            at, c = by << 10, out[todo]
            out[todo] = self.table[at + (c & 255)] ^ self.table[at + 256 + (c >> 8 & 255)] ^ self.table[at + 512 + (c >> 16 & 255)] ^ self.table[at + 768 + (c >> 24)]
            left[todo] -= by
            todo = todo[left[todo] > 0]
        return out


class Words(dict):
    """Numbers of words, with each word's crc, the crc of a space and the word, and its length."""

    def __init__(self):
        self.crc, self.spaced, self.size = array("I"), array("I"), array("I")

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.crc)
        self.crc.append(zlib.crc32(word))
        self.spaced.append(zlib.crc32(word, zlib.crc32(b" ")))
        self.size.append(len(word) + 1)
        return n


class Features:
    """Takes texts apart into the buckets of their features."""

    def __init__(self):
        self.separated, self.shift, self.words = _separated(), Shift(), Words()

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The number of words of each text, and for each length of run (places of the first words, buckets)."""
        if len(self.words) > REMEMBERED:
            self.words = Words()
        split = [t.translate(self.separated).split() if t else [] for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        ids = np.fromiter((self.words[w] for ws in split for w in ws), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(split)), sizes)
        spaced, length = np.array(self.words.spaced, np.uint32)[ids], np.array(self.words.size, np.uint32)[ids]
        crc, at = np.array(self.words.crc, np.uint32)[ids], np.arange(len(ids))
        found = [(at, (crc % BUCKETS).astype(np.int64))]
        for k in range(1, LONGEST_RUN):
            more = at[at + k < len(ids)]
            more = more[owner[more] == owner[more + k]]
            crc = self.shift(crc[: len(at)][np.searchsorted(at, more)], length[more + k]) ^ spaced[more + k]
            at = more
            found.append((at, (crc % BUCKETS).astype(np.int64)))
        return sizes, found


def _portions(batch: pa.RecordBatch, text: int):
    """Slices of a batch with about PORTION bytes of text, and their texts as bytes."""
    column = batch.column(text).cast(pa.binary())
    begin, size = 0, 0
    for i in range(len(column)):
        size += len(column[i].as_buffer() or b"") if column[i].is_valid else 0
        if size >= PORTION or i == len(column) - 1:
            yield batch.slice(begin, i + 1 - begin), column.slice(begin, i + 1 - begin).to_pylist()
            begin, size = i + 1, 0


def bucket_counts(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches):
        features, total = Features(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, texts in _portions(batch, 0):
                for _, buckets in features(texts)[1]:
                    total += np.bincount(buckets, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    sums = df.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in sums.collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the smoothed log ratio of each bucket's shares in the target and the raw table, rounded down."""
    s, t = raw.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(_id, n_words, n_features, weight) of every document."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def weigh(batches):
        features = Features()
        for batch in batches:
            for part, texts in _portions(batch, 1):
                sizes, found = features(texts)
                of_word = np.zeros(int(sizes.sum()) + 1, np.int64)
                for at, buckets in found:
                    of_word[at + 1] += gain[buckets]
                ends = np.r_[0, np.cumsum(sizes)]
                weight = np.diff(np.cumsum(of_word)[ends])
                n = sum(np.maximum(sizes - k, 0) for k in range(LONGEST_RUN))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(n), pa.array(weight)], ["_id", "n_words", "n_features", "weight"])

    kind = slim.schema["_id"].dataType.simpleString()
    return slim.mapInArrow(weigh, f"_id {kind}, n_words long, n_features long, weight long")


def gumbel(id_: Column, seed: int) -> Column:
    """A thousand times a Gumbel number drawn from the sha256 of seed and id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


#: The sort key: highest score first, then the smaller id (nulls last), then the row.
KEY = ("_down", "_null", "_id", "_row")


def _keys(batch: pa.RecordBatch, first: int = 0) -> list[np.ndarray]:
    """The key's columns from `first` on; a null id has the value of another row, which its flag puts last anyway."""
    columns = []
    for k in range(first, first + len(KEY)):
        c = batch.column(k)
        if c.null_count:
            known = c.drop_null()
            c = c.fill_null(known[0] if len(known) else pa.scalar(0, c.type) if pa.types.is_integer(c.type) else pa.scalar("").cast(c.type))
        columns.append(c.to_numpy(zero_copy_only=False))
    return columns


def regular_samples(each: int):
    """mapInArrow over sorted partitions: rows at regular places of the run, `each` to 2 * `each` of them (all, if fewer), with the distance `step`."""

    def sample(batches):
        step, seen, kept = 1, 0, []
        for batch in batches:
            places = np.arange(-seen % step, len(batch), step)
            kept += batch.take(pa.array(places)).to_pylist()
            seen += len(batch)
            while len(kept) > 2 * each:
                kept, step = kept[::2], 2 * step
        if seen:
            yield pa.RecordBatch.from_pylist([r | {"step": step} for r in kept], pa.schema([*batch.schema, ("step", pa.int64())]))

    return sample


def splitters(samples: list, segments: int) -> list[tuple]:
    """Keys that cut the sampled rows into `segments` parts of about equal weight."""
    ordered = sorted(samples, key=lambda r: (r[0], r[1], 0 if r[1] else r[2], r[3]))
    ends = np.cumsum([r[-1] for r in ordered])
    at = sorted({int(np.searchsorted(ends, ends[-1] * k / segments)) for k in range(1, segments)}) if ordered else []
    return [tuple(ordered[i][:-1]) for i in at]


def places(keys: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """For each row the number of splitters at or before it: a binary search over all rows at once."""
    low, high = np.zeros(len(keys[0]), np.int64), np.full(len(keys[0]), len(cuts[0]), np.int64)
    while (open_ := low < high).any():
        mid = np.where(open_, (low + high) // 2, 0)
        before, equal = np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for k, (own, cut_) in enumerate(zip(keys, cuts)):
            theirs = cut_[mid]
            if k == 2:  # ids of rows without one aren't compared
                known = keys[1] == 0
                before, equal = before | (equal & known & np.asarray(theirs < own, bool)), equal & (~known | np.asarray(theirs == own, bool))
            else:
                before, equal = before | (equal & (theirs < own)), equal & (theirs == own)
        at_or_before = before | equal
        low, high = np.where(open_ & at_or_before, mid + 1, low), np.where(open_ & ~at_or_before, mid, high)
    return low


def ranked(rows: DataFrame, draws: int, segments: int | None = None) -> DataFrame:
    """`rows` (a written table with _id, score, _row, eligible) with `rank`, 1 to `draws` in the order of the key, else null."""
    spark = rows.sparkSession
    segments = max(2, min(SEGMENTS, segments or 4 * partitions(spark)))
    keyed = rows.withColumns({"_down": -F.col("score"), "_null": F.col("_id").isNull().cast("int")})
    eligible = keyed.where("eligible").select(*KEY)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in eligible.schema)
    samples = eligible.sortWithinPartitions("_down", "_null", "_id", "_row").mapInArrow(regular_samples(segments), f"{kinds}, step long").collect()
    cuts = splitters(samples, segments)

    def deal(batches):
        last = None
        for batch in batches:
            own = _keys(batch)
            if last is None or last[2].dtype != own[2].dtype:
                known = next((c[2] for c in cuts if c[2] is not None), own[2][0] if len(batch) else 0)
                last = [np.array([c[k] if c[k] is not None else known for c in cuts], own[k].dtype) for k in range(len(KEY))]
            segment = np.where(batch.column(len(KEY)).to_numpy(zero_copy_only=False), places(own, last) if cuts else 0, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment, pa.int32())], [*batch.schema.names, "segment"])

    others = [c for c in rows.columns if c not in ("_id", "_row", "eligible")]
    dealt = keyed.select(*KEY, "eligible", *others)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    dealt = cut(dealt.mapInArrow(deal, f"{kinds}, segment int"))
    sizes = dict(dealt.where("segment >= 0").groupBy("segment").count().collect())  # at most SEGMENTS rows
    offsets, total = [], 0
    for s in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(s, 0)
    exchanged = sum(o < draws for o in offsets)
    drawn = F.col("segment").between(0, exchanged - 1)
    nth = F.row_number().over(W.partitionBy("segment").orderBy("_down", "_null", "_id", "_row"))
    rank = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets[:exchanged] or [0]]), F.col("segment") + 1) + nth
    names = ["_id", *others]
    top = dealt.where(drawn).withColumn("rank", rank).select(*names, F.when(F.col("rank") <= draws, F.col("rank")).cast("long").alias("rank"))
    return top.unionByName(dealt.where(~drawn).select(*names, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank): every document's score, and the rank of the `percent` per cent that are drawn."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))
    n = Observation()
    scored = weighted(docs, gain, id_col, text_col).withColumns({"score": F.col("weight") + gumbel(F.col("_id"), seed), "eligible": F.col("n_words") >= least_words, "_row": F.monotonically_increasing_id()})
    scored = cut(scored.observe(n, F.count(F.when(F.col("eligible"), 1)).alias("n")).drop("n_words"))
    return ranked(scored, percent * n.get["n"] // 100).select(F.col("_id").alias(id_col), "n_features", "weight", "score", "rank")


def op11_importance_resample(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: crc32 of the bytes of a string x in SQL: the bytes are read off its hexadecimal form, the table is built by the rule.
CRC_SQL = """
crc_table AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) AS r(b))"""


def crc_sql(x: str) -> str:
    """SQL for the unsigned crc32 of the UTF-8 bytes of `x`, where crc_table.t is in reach."""
    byte = f"instr('0123456789ABCDEF', substr(hex(encode({x})), 2 * k + 1, 1)) * 16 + instr('0123456789ABCDEF', substr(hex(encode({x})), 2 * k + 2, 1)) - 17"
    return f"xor(list_reduce(list_transform(range(strlen({x})), lambda k: CAST({byte} AS BIGINT)), lambda c, v: xor(c >> 8, t[1 + (xor(c, v) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295)"


QUERIES = {"op11_importance_resample": op11_importance_resample}
ORACLE_SQL = {
    "op11_importance_resample": f"""
WITH {CRC_SQL},
words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
features AS (
  SELECT side, id, array_to_string(w[i : i + k - 1], ' ') AS f, count(*) AS n
  FROM words, range(1, 4) AS r(k), unnest(range(1, len(w) - k + 2)) AS p(i) GROUP BY 1, 2, 3),
buckets AS (SELECT f, {crc_sql("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM features), crc_table),
counted AS (
  SELECT bucket, CAST(coalesce(sum(n) FILTER (WHERE side = 'd'), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (WHERE side = 'b'), 0) AS DOUBLE) AS t
  FROM features JOIN buckets USING (f) GROUP BY 1),
totals AS (SELECT sum(s) AS big_s, sum(t) AS big_t FROM counted),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (big_s + 10000) / ((s + 1) * (big_t + 10000)))) AS BIGINT) AS g FROM counted, totals),
weights AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight FROM features JOIN buckets USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1),
scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (id) WHERE side = 'd'),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 5 * count(*) OVER () // 100 AS draws FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= draws THEN rank END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
}
