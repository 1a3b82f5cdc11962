"""Approximate nearest neighbours by sign-bit hashes: compound keys, several probes, a sketch before each score.

Projections are rows of signs taken from MD5, so every engine and every run has the same ones. A vector has, for each table, a key of as many sign
bits as make buckets of ``bucket`` vectors on average (their number grows with the logarithm of the rows), and one long sketch of further sign
bits. It looks into its own bucket and those whose key differs in one of its most doubtful bits, those with the smallest projections. Of the vectors it meets, only
those are scored whose sketch is as near as the ``4 * k``-th nearest of a bounded sample of all vectors. So the work of a vector does not grow with the rows.

Buckets above ``cap`` vectors get more bits, from the front of the sketch; what even these cannot part (copies of one vector) is dealt in groups of ``cap``,
where a vector meets its own group. ``cap`` is at least a 2**17th of the rows, which bounds the list of such buckets that all tasks know.

Vectors that are null or hold null or non-finite components take no part; a zero vector scores zero. All vectors have one length.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.operators.blocks import MAX_TASKS, _best, cogroup_blocks
from ostinato.operators.shape import ranked
from ostinato.session import cut

DIGITS = 6
SAMPLE = 1024
SKETCH_BITS = 1024
#: Components are cut to this many steps of the largest one, so that projections are whole numbers and the same in every engine.
STEPS = 1 << 20
LEAD_BITS = 24
MOST_HOT = 1 << 17
HASHED = "id {id}, v binary, s binary, keys array<long>, probes array<long>, lead long"


def signs(dims: int, count: int):
    """``dims x count`` projections of +1 and -1: 128 signs of each MD5 of ``dimension:chunk``."""
    import numpy as np

    chunks = -(-count // 128)
    raw = b"".join(hashlib.md5(f"{d}:{c}".encode()).digest() for d in range(dims) for c in range(chunks))
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(dims, chunks * 16), axis=1)[:, :count]
    return bits.astype(np.float64) * 2 - 1


def hash_vectors(values, tables: int, bits: int, probes: int, projections):
    """Keys (rows x tables), probes (rows x tables * probes) and sketches (rows x bytes) of a matrix of vectors."""
    import numpy as np

    largest = np.abs(values).max(axis=1, keepdims=True)
    steps = np.floor(np.divide(values, largest, out=np.zeros_like(values), where=largest > 0) * STEPS + 0.5)
    projected = steps @ projections
    ones = projected > 0
    keys, asked = np.zeros((len(values), tables), np.int64), []
    for t in range(tables):
        here = slice(t * bits, (t + 1) * bits)
        place = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
        keys[:, t] = ones[:, here] @ place if bits else 0
        doubtful = np.argsort(np.abs(projected[:, here]), axis=1, kind="stable")[:, :probes - 1]
        asked.append(np.concatenate([keys[:, [t]], keys[:, [t]] ^ np.left_shift(np.int64(1), doubtful.astype(np.int64))], axis=1))
    return keys, np.concatenate(asked, axis=1), np.packbits(ones[:, tables * bits:], axis=1)


def distances(a, b):
    """Differing bits of sketches, as rows of 64-bit words."""
    import numpy as np

    out = np.zeros((len(a), len(b)), np.int32)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w][:, None] ^ b[:, w][None, :])
    return out


def words(sketches):
    import numpy as np

    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


class Plan:
    """Sizes of the hashes for a number of rows."""

    def __init__(self, rows: int, dims: int, k: int, tables: int, probes: int, bucket: int):
        self.rows, self.dims, self.k = rows, dims, k
        self.bits = max(0, int(math.floor(math.log2(max(1, rows) / bucket)))) if rows > bucket else 0
        self.tables = tables if self.bits else 1
        self.probes = min(probes, self.bits + 1)
        self.cap = max(4096, 4 * bucket, rows // MOST_HOT)

    def projections(self):
        return signs(self.dims, self.tables * self.bits + SKETCH_BITS)


def hashed(rows: DataFrame, plan: Plan, kind: str) -> DataFrame:
    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        projections = plan.projections()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
                values = flat.astype(np.float64).reshape(part.num_rows, plan.dims)
                keys, probes, sketch = hash_vectors(values, plan.tables, plan.bits, plan.probes, projections)
                lead = [int.from_bytes(s[:LEAD_BITS // 8].tobytes(), "big") for s in sketch]
                plain = np.ascontiguousarray(flat).reshape(part.num_rows, plan.dims)
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array([x.tobytes() for x in plain], pa.binary()), pa.array([x.tobytes() for x in sketch], pa.binary()),
                    pa.array(keys.tolist(), pa.list_(pa.int64())), pa.array(probes.tolist(), pa.list_(pa.int64())), pa.array(lead, pa.int64())],
                    names=["id", "v", "s", "keys", "probes", "lead"])

    return rows.mapInArrow(run, HASHED.format(id=kind))


def hot_buckets(rows: DataFrame, plan: Plan) -> dict[tuple[int, int], int]:
    """Extra bits of the buckets above the cap; at most ``tables * 2**17`` of them."""
    sizes = rows.select(F.posexplode("keys").alias("t", "key")).groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > plan.cap)
    return {(r.t, r.key): min(LEAD_BITS, math.ceil(math.log2(r.n / plan.cap))) for r in sizes.toLocalIterator()}


def grouped(rows: DataFrame, plan: Plan, hot: dict[tuple[int, int], int], kind: str) -> DataFrame:
    """Adds ``items`` and ``asked``: the groups that a vector is in and those it looks into, table by table."""
    def run(batches: Iterator):
        import pyarrow as pa

        def groups(keys, lead, per_table):
            return [key << LEAD_BITS | (lead >> LEAD_BITS - hot[i // per_table, key] if (i // per_table, key) in hot else 0) for i, key in enumerate(keys)]

        for batch in batches:
            lead = batch.column("lead").to_pylist()
            found = [[groups(keys, x, per) for keys, x in zip(batch.column(name).to_pylist(), lead)] for name, per in (("keys", 1), ("probes", plan.probes))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "v", "s")] + [pa.array(f, pa.list_(pa.int64())) for f in found], names=["id", "v", "s", "items", "asked"])

    return rows.mapInArrow(run, f"id {kind}, v binary, s binary, items array<long>, asked array<long>")


def score_group(asking, items, plan: Plan, limits, dtype: str):
    """The best ``k`` of the items that each asking vector meets for the first time and whose sketch is near enough; with counts."""
    import numpy as np
    import pandas as pd

    none = pd.DataFrame({"src": asking["id"].iloc[:0], "dst": items["id"].iloc[:0], "score": np.array([], float), "met": np.array([], np.int64), "scored": np.array([], np.int64)})
    if asking.empty or items.empty:
        return none
    table, found = int(items["t"].iloc[0]), [none]
    unit = {}
    for name, side in (("a", asking), ("i", items)):
        m = np.frombuffer(b"".join(side["v"]), dtype).reshape(len(side), -1).astype(np.float64)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        unit[name] = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    sketches, own, ids = words(items["s"].tolist()), np.array(items["items"].tolist(), np.int64), items["id"].to_numpy()
    met = scored = 0
    for at in range(0, len(asking), 128):
        part = asking.iloc[at:at + 128]
        mine, wanted = words(part["s"].tolist()), np.array(part["asked"].tolist(), np.int64)
        fresh = part["id"].to_numpy()[:, None] != ids[None, :]
        for t in range(table):
            for p in range(t * plan.probes, (t + 1) * plan.probes):
                fresh &= wanted[:, p][:, None] != own[:, t][None, :]
        limit = np.partition(distances(mine, limits), min(4 * plan.k, len(limits)) - 1, axis=1)[:, min(4 * plan.k, len(limits)) - 1]
        near = fresh & (distances(mine, sketches) <= limit[:, None])
        met, scored = met + int(fresh.sum()), scored + int(near.sum())
        r, c = np.nonzero(near)
        scores = np.full(near.shape, -np.inf)
        scores[r, c] = np.einsum("ij,ij->i", unit["a"][at + r], unit["i"][c])
        r, c, s = _best(scores, ids, plan.k, DIGITS)
        found.append(pd.DataFrame({"src": part["id"].to_numpy()[r], "dst": ids[c], "score": s, "met": 0, "scored": 0}))
    found.append(pd.DataFrame({"src": asking["id"].iloc[:1], "dst": items["id"].iloc[:1], "score": [float("nan")], "met": [met], "scored": [scored]}))
    return pd.concat([f for f in found if len(f)], ignore_index=True)


def scored_pairs(vectors: DataFrame, k: int, vector: str, id_col: str, tables: int, probes: int, bucket: int) -> tuple[DataFrame, int]:
    """Rows ``(src, dst, score)`` of each group's best, one row of counts (score NaN) a group, and the number of vectors."""
    kind = vectors.schema[id_col].dataType.simpleString()
    dtype = "<f4" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.col(vector).isNotNull() & ~bad).select(F.col(id_col).alias("id"), (F.col(vector) if dtype == "<f4" else F.col(vector).cast("array<double>")).alias("v"))
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    plan = Plan(n, dims, k, tables, probes, bucket)
    keyed = cut(hashed(rows, plan, kind), "hashed")
    sample = keyed.select("id", "s").orderBy(F.md5(F.col("id").cast("string")), "id").limit(SAMPLE).collect()
    limits = words([bytes(r.s) for r in sample]) if sample else None
    placed = grouped(keyed, plan, hot_buckets(keyed, plan), kind)
    items = placed.select("id", "v", "s", "items", F.posexplode("items").alias("t", "g"))
    asking = placed.select("id", "v", "s", "asked", F.posexplode("asked").alias("p", "g")).select("id", "v", "s", "asked", F.floor(F.col("p") / plan.probes).cast("int").alias("t"), "g")
    sizes = items.groupBy("t", "g").agg(F.ceil(F.count("*") / plan.cap).cast("int").alias("parts"))
    many = F.broadcast(sizes.filter("parts > 1").withColumnsRenamed({"t": "mt", "g": "mg"}))  # at most rows * tables / cap of them, bounded as the cap grows with the rows

    def dealt(df: DataFrame) -> DataFrame:
        j = df.join(many, (F.col("t") == F.col("mt")) & (F.col("g") == F.col("mg")), "left").drop("mt", "mg")
        b = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int").alias("b")
        return j.select(*[F.col(c).alias(c) for c in df.columns], b)  # renewed columns, as both sides come from one frame

    tasks = min(MAX_TASKS, -(-n * plan.tables * plan.probes // 4096))
    found = cogroup_blocks(dealt(asking), dealt(items), ["t", "g", "b"], tasks, lambda a, i: score_group(a, i, plan, limits, dtype),
                           f"src {kind}, dst {kind}, score double, met long, scored long")
    return found, n


def neighbours(vectors: DataFrame, k: int = 10, vector: str = "embedding", id_col: str = "vec_id", tables: int = 4, probes: int = 3, bucket: int = 256) -> DataFrame:
    """Approximate cosine neighbours ``(src, dst, score, rank)``."""
    found, _ = scored_pairs(vectors, k, vector, id_col, tables, probes, bucket)
    return ranked(found.filter(~F.isnan("score")).select("src", "dst", "score"), ["src"], [F.desc("score"), F.asc("dst")], k)


def recall(vectors: DataFrame, exact: DataFrame, k: int = 10, vector: str = "embedding", id_col: str = "vec_id", tables: int = 4, probes: int = 3, bucket: int = 256) -> DataFrame:
    """One row: exact edges, those found, their share, and the shares of all pairs that were met and that were scored."""
    found, n = scored_pairs(vectors, k, vector, id_col, tables, probes, bucket)
    found = cut(found, "scored")
    approx = ranked(found.filter(~F.isnan("score")).select("src", "dst", "score"), ["src"], [F.desc("score"), F.asc("dst")], k)
    hits = exact.select("src", "dst").withColumn("_e", F.lit(1)).join(approx.select("src", "dst").withColumn("_a", F.lit(1)), ["src", "dst"], "left")
    one = hits.agg(F.count("*").alias("edges"), F.count("_a").alias("found"))
    pairs = float(max(1, n * (n - 1)))
    counts = found.agg(F.coalesce(F.sum("met"), F.lit(0)).alias("met"), F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"))
    return one.join(counts).select("edges", "found", F.round(F.col("found") / F.greatest("edges", F.lit(1)), 6).alias("recall"),
                                   F.round(F.col("met") / pairs, 6).alias("met_share"), F.round(F.col("scored") / pairs, 6).alias("scored_share"))
