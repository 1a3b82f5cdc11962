import zlib
from collections import defaultdict

from helpers import LONG, docs_frame, with_odd_rows
from pyspark.sql import functions as F

from ostinato.llm import sharding

MASK = (1 << 64) - 1


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) & MASK
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_as_published(spark):
    df = spark.range(-300, 300).withColumn("k", F.xxhash64("id"))
    for n in (1, 2, 40, 333):
        assert all(r.s == jump(r.k & MASK, n) for r in df.select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect())


def test_new_shards_only_take(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("k"))
    rows = df.select(sharding.jump_hash(F.col("k"), 9).alias("a"), sharding.jump_hash(F.col("k"), 10).alias("b")).collect()
    assert all(r.a == r.b or r.b == 9 for r in rows)
    assert 150 < sum(r.a != r.b for r in rows) < 450


def test_shards_and_slots(spark):
    texts = ["a", None, "", "é" * 3, LONG] * 30
    docs = with_odd_rows(docs_frame(spark, texts, {"shard": "x", "slot": 1, "law": 2}), spark)
    docs = docs.unionByName(docs.limit(1)).unionByName(docs.limit(1))
    rows = sharding.assign_shards(docs, 4).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        text = (texts[r.doc_id] if r.doc_id is not None else None) or ""
        assert (r["size"], r.text_crc32, r.law) == (len(text.encode()) + 16, zlib.crc32(text.encode()), "key")
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.assign_shards(docs.limit(0), 4).count() == 0
