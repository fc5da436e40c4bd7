"""Sharding by fixed virtual slots.

1. A record's slot is a hash of its id and text: SLOTS slots, whatever the number of records or shards.
2. Bytes and records are added up by slot: SLOTS rows.
3. A versioned map says which shard owns each slot.  The first version deals slots around; rebalancing edits it by moves and
   exchanges of slots between a heavy shard and the lightest; growing moves slots into the new shard alone.  Each version is a table
   of SLOTS rows in one folder, never rewritten, so readers of an older version go on undisturbed.
4. Records get their place in the shard, without a gap: they are numbered inside parts of their slot, and shifted by the
   records of the parts before.  A part has about PART records at most, so no shard and no slot is ever numbered in one task.

Law: `bytes`.  Shard sizes end up within the smallest slot of the heaviest shard of each other, unless single slots are larger
than a shard's share.  Records with equal texts have different slots, as their ids are hashed, too: a group of copies may hold a
third of all rows, and shards that kept it together couldn't be of equal size.  What goes through the driver is the map and the
sums by slot, of fixed size.

Defined cases: a null text has no bytes, so its size is the overhead alone and its crc that of the empty text; a null id is
an id; rows that repeat id and text share a slot (which is numbered in parts, too); an empty table gives no rows; further
columns are left out by `sharded`.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, shared_dir

SLOTS = 8192
OVERHEAD = 16
#: Records numbered together.
PART = 200_000


def slot_of(*key: Column | str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(SLOTS)).cast("int")


def loads(owner: np.ndarray, size: np.ndarray, shards: int) -> np.ndarray:
    """Bytes of each shard."""
    return np.bincount(owner, weights=size, minlength=shards).astype(np.int64)


def dealt(shards: int) -> np.ndarray:
    """The first version of a map: slots around the shards."""
    return np.arange(SLOTS) % shards


def rebalanced(owner: np.ndarray, size: np.ndarray, shards: int) -> np.ndarray:
    """The map with slots moved or exchanged until no single move or exchange brings a heavy shard and the lightest closer.

    Each step takes the heaviest shard that can still give to the lightest: the slot nearest to half their difference moves;
    if none is small enough, the pair of slots whose exchange comes nearest does.  Every step lowers the sum of squared
    loads, so it ends; it works on SLOTS numbers.
    """
    owner, load = owner.copy(), loads(owner, size, shards)
    while True:
        light = int(np.argmin(load))
        for heavy in np.argsort(-load, kind="stable"):
            gap = int(load[heavy] - load[light])
            if gap <= 1:
                return owner
            own = np.flatnonzero((owner == heavy) & (size > 0))
            movable = own[size[own] < gap]
            if len(movable):
                best = movable[np.argmin(np.abs(2 * size[movable] - gap))]
                owner[best] = light
                load[heavy] -= size[best]
                load[light] += size[best]
                break
            theirs = np.flatnonzero((owner == light) & (size > 0))
            if len(own) and len(theirs):
                order = theirs[np.argsort(size[theirs], kind="stable")]
                near = np.clip(np.searchsorted(size[order], size[own] - gap / 2), 0, len(order) - 1)
                options = [(abs(2 * int(size[a] - size[b]) - gap), int(a), int(b)) for a, n in zip(own, near) for b in order[max(n - 1, 0) : n + 1] if 0 < size[a] - size[b] < gap]
                if options:
                    _, a, b = min(options)
                    owner[a], owner[b] = light, heavy
                    load[heavy] -= size[a] - size[b]
                    load[light] += size[a] - size[b]
                    break
        else:
            return owner


def grown(owner: np.ndarray, size: np.ndarray, shards: int) -> np.ndarray:
    """The map with one more shard, numbered `shards`: slots move into it only, each from the shard that is heaviest just then."""
    owner, load = owner.copy(), loads(owner, size, shards + 1)
    share = load.sum() / (shards + 1)
    while True:
        for heavy in np.argsort(-load[:shards], kind="stable"):
            own = np.flatnonzero((owner == heavy) & (size > 0))
            excess = load[heavy] - share
            fits = own[(size[own] <= share - load[shards]) & (size[own] < 2 * excess)]
            if len(fits):
                best = fits[np.argmin(np.abs(size[fits] - excess))]
                owner[best] = shards
                load[heavy] -= size[best]
                load[shards] += size[best]
                break
        else:
            return owner


class SlotMaps:
    """The versions of a slot map, one folder each below `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def publish(self, version: int, owner: np.ndarray) -> None:
        """Writes a version as one file, whose commit is one step; a version that is there already is an error."""
        rows = self.spark.createDataFrame([(k, int(s)) for k, s in enumerate(owner)], "slot int, shard int")
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/version={version}")

    def frame(self, version: int) -> DataFrame:
        return self.spark.read.schema("slot int, shard int").parquet(f"{self.path}/version={version}")

    def load(self, version: int | None = None) -> tuple[int, np.ndarray]:
        """A version's number and map; of the versions that are whole, the last, unless one is named."""
        rows = self.spark.read.schema("slot int, shard int, version int").parquet(self.path)
        if version is None:
            version = rows.groupBy("version").count().where(F.col("count") == SLOTS).agg(F.max("version")).first()[0]
            if version is None:
                raise FileNotFoundError(f"no whole version of a slot map in {self.path}")
        found = self.frame(version).collect()  # SLOTS rows
        owner = np.zeros(SLOTS, np.int64)
        for r in found:
            owner[r["slot"]] = r["shard"]
        return version, owner

    def edit(self, change) -> int:
        """Publishes change(map of the last version) as the next version; of two writers that edit at once, one gets an error."""
        version, owner = self.load()
        self.publish(version + 1, change(owner))
        return version + 1


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, size, text_crc32, vslot, _row) of each record, written once: texts are read a single time."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return cut(rows.withColumns({"vslot": slot_of("_id", "text_crc32"), "_row": F.monotonically_increasing_id()}))


def slot_sums(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and records of every slot."""
    size, count = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():  # SLOTS rows at most
        size[r["vslot"]], count[r["vslot"]] = r["size"], r["n"]
    return size, count


def sharded(rows: DataFrame, shard_map: DataFrame, count: np.ndarray) -> DataFrame:
    """`rows` with `shard` and `slot`, the gapless place in the shard, in the order of (virtual slot, part, id)."""
    spark = rows.sparkSession
    parts = spark.createDataFrame([(k, int(-(-n // PART))) for k, n in enumerate(count)], "vslot int, parts int")  # SLOTS rows
    slots = F.broadcast(shard_map.withColumnRenamed("slot", "vslot").join(parts, "vslot"))
    placed = rows.join(slots, "vslot").withColumn("part", F.pmod(F.xxhash64("_row"), F.col("parts")).cast("int"))
    sizes = placed.groupBy("shard", "vslot", "part").agg(F.count("*").alias("n"))
    ahead = W.partitionBy("shard").orderBy("vslot", "part")  # a row a part: one for PART records
    offsets = sizes.select("vslot", "part", (F.sum("n").over(ahead) - F.col("n")).alias("offset"))
    nth = F.row_number().over(W.partitionBy("vslot", "part").orderBy("_id", "_row")) - 1
    return placed.withColumn("nth", nth).join(offsets, ["vslot", "part"]).withColumn("slot", (F.col("offset") + F.col("nth")).cast("long")).drop("parts", "part", "nth", "offset")


def balanced_shards(docs: DataFrame, shards: int = 40, maps: SlotMaps | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, vslot, version, shard, slot): `docs` in shards of near equal bytes.

    Without `maps` a new folder gets version 0; with it, its last version is the one that is edited.
    """
    spark = docs.sparkSession
    rows = sized(docs, id_col, text_col)
    size, count = slot_sums(rows)
    if maps is None:
        maps = SlotMaps(spark, f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}")
        maps.publish(0, dealt(shards))
    version = maps.edit(lambda owner: rebalanced(owner, size, shards))
    out = sharded(rows, maps.frame(version), count)
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", "vslot", F.lit(version).alias("version"), "shard", "slot")


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = balanced_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op12_sharding": op12_sharding}
ORACLE_SQL: dict[str, str] = {}
