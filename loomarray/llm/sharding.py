"""Operator 2: sharding through fixed virtual slots."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomarray.llm.common import fresh_path, materialise

#: Records hash into so many slots, whatever the number of shards.  The map has this many entries.
SLOTS = 8192
#: Bytes that a record takes besides its text.
HEADER = 16


@dataclass
class SlotMap:
    """Which shard each virtual slot is in.  Every edit makes the next version and is kept with it."""

    shards: int
    shard_of: np.ndarray
    version: int = 0
    edits: list[tuple[int, int, int]] = field(default_factory=list)  # (version, slot, shard)

    @classmethod
    def fresh(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(shards, np.arange(slots) % shards)

    def rebalanced(self, load: np.ndarray, shards: int | None = None) -> SlotMap:
        """The next version: slots leave the heaviest shard, or change places with a lighter slot of
        the lightest, as long as that lowers the larger of the two loads.

        `load` has the bytes of each slot.  With more shards, the new ones begin empty.
        """
        n, of = shards or self.shards, self.shard_of.copy()
        total = np.bincount(of, load, n)
        for _ in range(64 * len(of)):
            high, low = int(total.argmax()), int(total.argmin())
            gap = total[high] - total[low]
            a, b = np.flatnonzero(of == high), np.flatnonzero(of == low)
            a = a[np.argsort(load[a], kind="stable")]
            b = np.concatenate([[-1], b[np.argsort(load[b], kind="stable")]])  # -1: nothing comes back
            back = np.where(b < 0, 0.0, load[b])
            at = np.searchsorted(load[a], back + gap / 2)
            best = None
            for shift in (-1, 0):
                i = np.clip(at + shift, 0, len(a) - 1)
                gain = load[a][i] - back if len(a) else np.zeros(len(b))
                left = np.abs(gap - 2 * gain)
                left[(gain <= 0) | (gain >= gap)] = gap
                k = int(left.argmin())
                if left[k] < gap and (best is None or left[k] < best[0]):
                    best = left[k], int(a[i[k]]), int(b[k])
            if best is None:
                break
            _, give, take = best
            of[give] = low
            if take >= 0:
                of[take] = high
            total = np.bincount(of, load, n)
        moved = np.flatnonzero(of != self.shard_of)
        edits = [(self.version + 1, int(s), int(of[s])) for s in moved]
        return SlotMap(n, of, self.version + 1, [*self.edits, *edits])

    def save(self, spark: SparkSession, path: str) -> None:
        """One more version in the folder `path`; versions that are there stay."""
        row = (self.version, self.shards, self.shard_of.tolist(), json.dumps(self.edits))
        spark.createDataFrame([row], "version int, shards int, shard_of array<int>, edits string").coalesce(1).write.mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version, or the latest."""
        rows = spark.read.parquet(path)
        r = (rows.where(F.col("version") == version) if version is not None else rows.orderBy(F.desc("version"))).first()
        return cls(r.shards, np.array(r.shard_of), r.version, [tuple(x) for x in json.loads(r.edits)])


def slot_of(*key, slots: int = SLOTS):
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


#: Rows alike in everything that one task writes out again.
ALIKE = 1 << 16


def numbered_copies(rows: DataFrame) -> DataFrame:
    """The same rows, with a number `_copy` (from 0) among those that are alike in all columns.

    Alike rows are counted, before and after a shuffle, and written out again from their count; large
    counts in parts, so that no task holds the rows of one hot key.
    """
    names = rows.columns
    counted = materialise(rows.groupBy(*names).agg(F.count("*").alias("_n")), "sizes")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    few = counted.where(F.col("_n") <= ALIKE).select(*names, F.explode(upto(F.col("_n"))).alias("_copy"))
    parts = counted.where(F.col("_n") > ALIKE).select("*", F.explode(upto(F.ceil(F.col("_n") / ALIKE))).alias("_part")).repartition("_part", *names)
    at = F.col("_part") * ALIKE
    many = parts.select(*names, F.explode(F.sequence(at, F.least(at + ALIKE, F.col("_n")) - 1)).alias("_copy"))
    return few.unionByName(many)


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Deal all documents to shards so that the bytes of the shards are near equal (law `bytes`).

    Size: UTF-8 bytes of the text (null: none) plus 16.  A record's virtual slot is a hash of its doc_id,
    text and size, and of its number among rows alike in these.  So copies of a text, repeated rows and
    rows without an id all spread over the slots: a group of equal texts that holds a third of all rows could
    not be in one shard with sizes near equal.  Bytes and rows of each slot are summed
    before the shuffle; the slot-to-shard map (one entry a slot, a fixed number) starts as version
    0, is rebalanced by the measured bytes into version 1, and both are stored at `path` (default:
    a new folder among the shared ones).  A record's `slot` is its place in its shard, gapless from
    0: the records before its virtual slot, from the map, plus its rank in it, so no window holds
    more than one virtual slot.

    Per document: doc_id, size, text_crc32 (null text: of no bytes), law, shard, slot, grown_shard
    (null under this law), virtual_slot.  An empty table gives no rows; other columns are dropped.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + HEADER).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = numbered_copies(rows).withColumn("virtual_slot", slot_of("doc_id", "text_crc32", "size", "_copy", slots=slots))
    load, count = np.zeros(slots), np.zeros(slots, np.int64)
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():  # at most one row a slot
        load[r.virtual_slot], count[r.virtual_slot] = r.bytes, r.n
    first = SlotMap.fresh(shards, slots)
    placed = first.rebalanced(load)
    path = path or fresh_path(spark, "slot-map")
    for version in (first, placed):
        version.save(spark, path)
    before = np.zeros(slots, np.int64)
    for k in range(shards):
        own = np.flatnonzero(placed.shard_of == k)
        before[own] = np.cumsum(count[own]) - count[own]
    schema = T.StructType([T.StructField("virtual_slot", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("_before", T.LongType())])
    table = spark.createDataFrame(list(zip(range(slots), placed.shard_of.tolist(), before.tolist(), strict=True)), schema)
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "_copy")) - 1
    return (
        rows.withColumn("_rank", rank)
        .join(F.broadcast(table), "virtual_slot")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
    )
