"""Sharding by jump consistent hashing, in column expressions only.

The shard of a row follows from its key and the number of shards alone (law ``key``): no ring table, and with one more
shard a row either stays or moves into the new one. Slots number the rows of a shard without gaps. They come from row
counts of small buckets of each shard and places inside a bucket, so neither a shard nor a run of repeated rows is sorted
in one task.

A null key is a key like any other; a null text has no bytes and checksum 0. Repeated rows each get a slot of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.llm.common import text_or_empty
from ostinato.session import cut

#: Multiplier of the published jump hash.
MULTIPLIER = 2862933555777941757
LIMB = (1 << 22) - 1
#: Buckets of a shard for numbering: a fixed count, so the table of bucket starts is at most shards * BUCKETS rows.
BUCKETS = 1024


def next_state(key: Column) -> Column:
    """``key * MULTIPLIER + 1`` modulo 2**64, in limbs of 22 bits so that no step overflows."""
    m0, m1, m2 = MULTIPLIER & LIMB, (MULTIPLIER >> 22) & LIMB, MULTIPLIER >> 44
    a0 = key.bitwiseAND(F.lit(LIMB))
    a1 = F.shiftrightunsigned(key, 22).bitwiseAND(F.lit(LIMB))
    a2 = F.shiftrightunsigned(key, 44)
    t0 = a0 * F.lit(m0) + F.lit(1)
    t1 = a0 * F.lit(m1) + a1 * F.lit(m0) + F.shiftrightunsigned(t0, 22)
    t2 = a0 * F.lit(m2) + a1 * F.lit(m1) + a2 * F.lit(m0) + F.shiftrightunsigned(t1, 22)
    return F.shiftleft(t2, 44).bitwiseOR(F.shiftleft(t1.bitwiseAND(F.lit(LIMB)), 22)).bitwiseOR(t0.bitwiseAND(F.lit(LIMB)))


def jump_hash(key: Column, shards: int) -> Column:
    """Jump consistent hash of a bigint key into ``0 .. shards - 1``.

    Each jump goes forward by one shard at least, so ``shards`` steps always suffice; steps after the end change nothing.
    """
    start = F.struct(key.alias("key"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(state: Column, _: Column) -> Column:
        moved = next_state(state["key"])
        target = F.floor((state["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(moved, 33) + 1).cast("double"))).cast("long")
        return F.when(state["j"] < shards, F.struct(moved.alias("key"), state["j"].alias("b"), target.alias("j"))).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)["b"].cast("int")


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each row; ``size`` is the text's UTF-8 bytes plus ``overhead``.

    The narrow rows are stored once in the shared folder, then counted and numbered; texts are read once and never shuffled.
    """
    hashed = F.xxhash64(F.col(key))
    narrow = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(text_or_empty(text)) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text_or_empty(text)).alias("text_crc32"), jump_hash(hashed, shards).alias("shard"), jump_hash(hashed, shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64(F.col(key), F.lit("slot")), F.lit(BUCKETS)).cast("int").alias("bucket"))
    same = ["shard", "bucket", "doc_id", "size", "text_crc32", "grown_shard"]
    counted = cut(narrow.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")), "shards")
    sums = counted.groupBy("shard", "bucket").agg(F.sum("copies").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("place", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(F.broadcast(starts), ["shard", "bucket"])
    first = F.col("start") + F.col("place")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("slot"), "grown_shard")
