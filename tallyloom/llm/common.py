"""Helpers shared by the corpus operators: tables, checkpoints, hashing, packed rows."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Spark's setting that removes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder, set here only when the session names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder, so that a lost executor costs no recomputation.

    It is written as a table and read again, not checkpointed: a checkpointed frame keeps the constraints that Spark derived
    for its columns, and over the rounds of a loop these multiply until planning takes minutes and the driver's whole heap.
    What was shuffled to make the table is given up once it is written; otherwise it lies on the disks until the driver
    happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, leaving every other code point alone."""
    return F.translate(c, UPPER, LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of a text, A-Z lower-cased (bytes.lower and bytes.split do just that)."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


#: Odd multipliers for the words of a shingle.
MULT = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, in order; of the whole sequence when it is shorter; empty when there are no words."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out += words[i : n - k + 1 + i] * MULT[i]
    return mix(out + np.uint64(k))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order; a sort and a mask, several times as fast as numpy's unique on short arrays."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def split_by(owner: np.ndarray, *columns: np.ndarray):
    """Yields (owner, rows of each column) for each distinct value of `owner`; one stable sort, no loop over rows."""
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(owner)]):
        if b > a:
            yield int(owner[a]), [c[a:b] for c in columns]


def joined(parts, kind) -> np.ndarray:
    """One array from a column of packed binary values."""
    return np.frombuffer(b"".join(parts), kind)
