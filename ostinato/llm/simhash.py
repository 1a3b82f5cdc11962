"""SimHash near-duplicates with Pigeonring filtering.

Each text has a 64-bit fingerprint of its word shingles; texts whose fingerprints differ in at most ``LINK_BITS`` bits are
linked, and chains of links make a component. Copies meet in the table of distinct fingerprints, so all further work is on
different fingerprints only.

The fingerprint is a ring of three segments. If two fingerprints differ in at most 2 bits, some segment begins a chain
whose running differences stay within its share of the budget (2/3 a segment): 0 after one segment, at most 1 after two, at
most 2 after three. A candidate pair must agree on a whole segment and, as one difference cannot be in both halves, on a half
of the next; these 32 bits are the key of one of six tables. In a key's bucket the chain is checked before the full
Hamming distance.

A bucket of m fingerprints has m (m - 1) / 2 pairs. Where that is more than 65 rows a fingerprint, its members are instead
written under themselves and each one-bit neighbour: two fingerprints are within two bits exactly if they share such a key, and
every member is linked to the smallest of the key. Both ways are exact; no bucket is cut off.

Null texts count as empty; texts without words have fingerprint zero, which links like any other. Repeated rows stay and share
their component. Columns of the input stay; those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.llm.common import keeps_columns, text_or_empty
from ostinato.llm.graph import components
from ostinato.session import cut

BITS, LINK_BITS, SEED = 64, 2, 42
#: Segments of the ring: first bit and width; each is used in two halves.
SEGMENTS = [(0, 22), (22, 21), (43, 21)]
#: Members of a bucket up to which pairs are not more rows than one-bit neighbours.
PAIR_BUCKET = 2 * (BITS + 1) + 1
PART_WORDS = 1 << 18


def shingle_hashes(text: str, size: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of ``size`` words, repeats included, in parts of bounded size; none without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    size = min(size, len(words))
    total = len(words) - size + 1 if words else 0
    for at in range(0, total, PART_WORDS):
        part = words[at:min(at + PART_WORDS, total) + size - 1]
        flat = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(part) - size + 1
        yield np.fromiter((xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[size - 1:].tolist())), dtype="<u8", count=n)


def folded(sums: np.ndarray, total: int) -> int:
    return int(np.packbits(sums * 2 > total, bitorder="little").view("<u8")[0])


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str, size: int = 3) -> int:
    """Unsigned fingerprint of shingles of ``size`` words with their repeats."""
    sums, total = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(text, size):
        sums, total = sums + bit_sums(hashes), total + len(hashes)
    return folded(sums, total)


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, name: str = "bits") -> DataFrame:
    """Adds the fingerprint as a signed long."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, size) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(name, of(text_or_empty(text)))


def bits_of(value: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << width) - 1))


def chain_keys(value: Column) -> Column:
    """The six table keys of a fingerprint: number of the table, a whole segment, a half of the next one."""
    keys = []
    for i, (first, width) in enumerate(SEGMENTS):
        nxt, nxt_width = SEGMENTS[(i + 1) % 3]
        for h, (a, w) in enumerate(((nxt, 11), (nxt + 11, nxt_width - 11))):
            keys.append(F.shiftleft(bits_of(value, first, width), 11).bitwiseOR(bits_of(value, a, w)) + F.lit((2 * i + h) << 40))
    return F.array(*keys)


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def chain_holds(key: Column, a: Column, b: Column) -> Column:
    """At most one difference in the first two segments of the key's chain (none in the first), then at most two in all."""
    start, diff = F.shiftright(key, 41), a.bitwiseXOR(b)
    masks = [((1 << SEGMENTS[(i + 1) % 3][1]) - 1) << SEGMENTS[(i + 1) % 3][0] for i in range(3)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    mask = F.when(start == 0, F.lit(masks[0]).cast("long")).when(start == 1, F.lit(masks[1]).cast("long")).otherwise(F.lit(masks[2]).cast("long"))
    return (F.bit_count(diff.bitwiseAND(mask)) <= 1) & (F.bit_count(diff) <= LINK_BITS)


def links(distinct: DataFrame) -> DataFrame:
    """Links ``a, b`` between the different values of ``bits``: all that connectedness needs."""
    keys = distinct.select("bits", F.explode(chain_keys(F.col("bits"))).alias("key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("bits").alias("a"), F.max("bits").alias("b")).where("n > 1")
    buckets = cut(buckets, "buckets")
    twos = buckets.where("n = 2").where(chain_holds(F.col("key"), F.col("a"), F.col("b"))).select("a", "b")
    members = cut(keys.join(buckets.where("n > 2").select("key", "n"), "key"), "members")
    few = members.where(F.col("n") <= PAIR_BUCKET)
    left, right = few.select("key", F.col("bits").alias("a")), few.select(F.col("key").alias("key_b"), F.col("bits").alias("b"))
    pairs = left.join(right, (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b")) & chain_holds(F.col("key"), F.col("a"), F.col("b"))).select("a", "b")
    many = members.where(F.col("n") > PAIR_BUCKET).select("bits").distinct()
    flips = F.array(F.col("bits"), *[F.col("bits").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(BITS)])
    near = many.select("bits", F.explode(flips).alias("near")).groupBy("near").agg(F.min("bits").alias("a"), F.collect_set("bits").alias("all"))
    stars = near.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b")
    return twos.unionByName(pairs).unionByName(stars)


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row: 16 hex digits, and the smallest id its links reach."""
    rows = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text", size).select("doc_id", "bits"), "fingerprints")
    distinct = cut(rows.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(distinct.select("bits")))
    rooted = distinct.join(roots, distinct.bits == roots.node, "left").select("bits", "first_id", F.coalesce("root", "bits").alias("root"))
    rooted = cut(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("bits", "component_id")
    return rows.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


# Similarity of shingle sets --------------------------------------------------------------------------------------------------
#
# At a Jaccard similarity of 0.8 fingerprints differ in about ten bits, so a chain that surely holds would fix four bits only, and its
# buckets would hold a sixteenth of all texts. The general form below therefore takes candidates both from the fingerprint chains and from
# bands of minimum hashes. Candidates whose sketches are far apart go first; the rest are judged by their whole sets of shingles.

SKETCH, BAND, BANDS = 128, 4, 16
#: Multiplier that spreads small and neighbouring numbers over the high bits.
MIX = np.uint32(0x9E3779B1)
#: Sketches estimate similarities to 0.035 (standard deviation); pairs go to the exact test from this much below.
MARGIN, WIDE_MARGIN = 0.12, 0.2
#: Members of a band's bucket up to which all its pairs are compared.
SMALL_BUCKET = 16
#: Central members of a group that the others of its buckets are compared with before all of them are.
CENTRES = 8
#: Cells in which shingles are counted to put the frequent ones last, and the most cells that a task reports.
CELLS, TASK_CELLS = 1 << 20, 1 << 16


def sketch(text: str, size: int, multipliers: np.ndarray) -> tuple[int, bytes]:
    """Fingerprint, and SKETCH minimum hashes of the set of shingles, each mixed to 16 bits.

    A minimum over n shingles is about 2**32 / n, so its high bits are zero in long texts; the mixed bits tell minima apart at any length.
    """
    sums, total, least = np.zeros(BITS, dtype=np.int64), 0, np.full(SKETCH, 0xFFFFFFFF, dtype=np.uint32)
    for hashes in shingle_hashes(text, size):
        sums, total = sums + bit_sums(hashes), total + len(hashes)
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), 1024):
            least = np.minimum(least, (short[at:at + 1024, None] * multipliers).min(axis=0))
    return folded(sums, total), (least * MIX >> np.uint32(16)).astype("<u2").tobytes()


def sketches(docs: DataFrame, text: str, size: int) -> DataFrame:
    multipliers = np.random.default_rng(SEED).integers(0, 1 << 31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    @F.pandas_udf("bits long, sketch binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = [sketch(t, size, multipliers) for t in texts]
        return pd.DataFrame({"bits": np.array([r[0] for r in rows], dtype=np.uint64).view(np.int64), "sketch": [r[1] for r in rows]})

    return docs.withColumn("_s", of(text_or_empty(text)))


def shingle_sets(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """``node, shingles`` (distinct hashes of 32 bits) of the texts that are in pairs; texts of others are not moved further."""
    @F.pandas_udf("array<int>")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(t, size)]) >> np.uint64(32)).astype(np.uint32).view(np.int32) for t in texts])

    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    chosen = needed.join(nodes.select("node", "first_id"), "node")
    texts = docs.select(F.col(doc_id).alias("first_id"), text_or_empty(text).alias("_text")).join(chosen, "first_id")
    return cut(texts.select("node", hashed("_text").alias("shingles")).dropDuplicates(["node"]), "shingles")


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", common.alias("c"), (F.size("x") + F.size("y")).alias("n")).where(F.col("c") >= F.lit(similarity) * (F.col("n") - F.col("c"))).select("a", "b")


def close_sketches(pairs: DataFrame, distinct: DataFrame, least: float) -> DataFrame:
    """The different pairs ``a < b`` whose sketches agree in a share of at least ``least``."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = distinct.select("node", "sketch")
    pairs = pairs.join(side.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(side.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(v), dtype="<u2").reshape(-1, SKETCH) for v in (a, b))
        return pd.Series((x == y).mean(axis=1) >= least)

    return pairs.where(near("sa", "sb")).select("a", "b")


def frequent_cells(sets: DataFrame) -> np.ndarray:
    """About how many texts hold the shingles of each cell; CELLS numbers come to the driver. They only order shingles."""
    def count(batches):
        held = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            np.add.at(held, batch.column(0).flatten().to_numpy().view(np.uint32) % CELLS, 1)
        cells = np.argpartition(held, -TASK_CELLS)[-TASK_CELLS:]
        cells = cells[held[cells] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(held[cells])], names=["cell", "n"])

    import pyarrow as pa

    counts = np.zeros(CELLS, dtype=np.int64)
    rows = sets.select("shingles").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    counts[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return counts


def leaders(large: DataFrame) -> DataFrame:
    """``key, leaders``: the most central member of each large bucket in each of two shares of its members.

    ``large`` holds ``node, key, m``: the members of large buckets, and the buckets' sizes. Near copies with few changes share bands with most
    others, so a member is as central as its buckets are large together. The buckets of a group of near copies mostly have the same ones, so a member
    meets few different leaders, and those that are similar to most of the group.
    """
    weights = large.groupBy("node").agg(F.sum("m").alias("weight"))
    share = F.pmod(F.xxhash64("node"), F.lit(2))
    best = [F.max_by("node", F.when(share == i, F.struct("weight", "node"))) for i in range(2)]
    return large.join(weights, "node").groupBy("key").agg(F.array_compact(F.array(*best)).alias("leaders"))


def centre_pairs(opened: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of central members of a bucket's largest group and the bucket's members outside it.

    ``opened`` holds ``node, key, m, root``: the groups so far in the large buckets, and the buckets' sizes ``m``. Near copies with few changes share
    bands with most others, so a member is as central as its buckets are large together. One is taken from each of ``CENTRES`` shares of a group, so
    there are at most that many pairs a member and bucket. These pairs only save later ones; groups with few members in a bucket have none.
    """
    weights = opened.groupBy("root", "node").agg(F.sum("m").alias("weight"))
    slot = F.pmod(F.xxhash64("node"), F.lit(CENTRES))
    best = [F.max_by("node", F.when(slot == i, F.struct("weight", "node"))).alias(f"c{i}") for i in range(CENTRES)]
    centres = weights.groupBy(F.col("root").alias("main")).agg(*best).select("main", F.array_compact(F.array(*[f"c{i}" for i in range(CENTRES)])).alias("centres"))
    roots = opened.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mains = roots.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n")).where(F.col("n") > SMALL_BUCKET)
    outside = opened.join(mains.join(centres, "main").select("key", "main", "centres"), "key").where("root <> main").dropDuplicates(["node", "main"])
    return outside.select(F.explode("centres").alias("a"), F.col("node").alias("b"))


def prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """All candidate pairs of ``node, root, shingles`` with different roots, by an exact prefix filter.

    Shingles are put in one order, frequent ones last. Similar sets share a shingle among their first n - ceil(similarity * n) + 1, and
    their first shared one leaves enough places after it on both sides. In a shingle's bucket those outside its most
    common root meet all members, so texts that are linked already are not paired again.
    """
    cells = sets.sparkSession.sparkContext.broadcast(frequent_cells(sets))

    @F.pandas_udf("array<int>")
    def prefixes(shingles: pd.Series) -> pd.Series:
        def first(x):
            x = np.asarray(x, dtype=np.int32)
            n = len(x) - int(np.ceil(similarity * len(x) - 1e-6)) + 1
            return x[np.lexsort((x, cells.value[x.view(np.uint32) % CELLS]))[:n]]

        return pd.Series([first(x) for x in shingles])

    keys = cut(sets.select("node", "root", F.size("shingles").alias("n"), F.posexplode(prefixes("shingles")).alias("at", "key")), "prefixes")
    roots = keys.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    mixed = roots.groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("key", "main")
    mixed = cut(keys.join(mixed, "key"), "mixed")
    one = mixed.where("root <> main").select("key", F.col("node").alias("a"), F.col("root").alias("ra"), (F.col("n") - F.col("at")).alias("left_a"), F.col("n").alias("na"))
    two = mixed.select(F.col("key").alias("key_b"), F.col("node").alias("b"), F.col("root").alias("rb"), (F.col("n") - F.col("at")).alias("left_b"), F.col("n").alias("nb"))
    enough = F.least("left_a", "left_b") * F.lit(1 + similarity) >= F.lit(similarity) * (F.col("na") + F.col("nb")) - F.lit(1e-6)
    return one.join(two, (F.col("key") == F.col("key_b")) & (F.col("ra") != F.col("rb")) & enough).select("a", "b")


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, component_id``: groups of texts whose sets of shingles of ``size`` words are similar, by chains of similar pairs.

    Texts with equal sketches count as copies and meet first. Small buckets of a band compare all pairs, large ones their members with
    two central ones (``leaders``). Members of large buckets that are not all in one group by then are compared with central members of the largest group there
    (``centre_pairs``); those still in different groups meet again by shared rare shingles (``prefix_pairs``), so no similar pair of a bucket
    is left out. Rows without id are in no group.
    """
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    rows = sketches(rows, "_text", size).select("doc_id", F.xxhash64("_s.bits", "_s.sketch").alias("node"), "_s.bits", "_s.sketch")
    rows = cut(rows, "sketches")
    distinct = cut(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("bits").alias("bits"), F.first("sketch").alias("sketch")), "distinct")
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", 2 * BAND * i + 1, 2 * BAND)) for i in range(BANDS)])
    keys = cut(distinct.select("node", F.explode(bands).alias("key")), "bands")
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = cut(keys.join(buckets, "key"), "members")
    large = members.where(F.col("m") > SMALL_BUCKET)
    stars = large.join(leaders(large), "key").select(F.explode("leaders").alias("a"), F.col("node").alias("b"))
    few = members.where(F.col("m") <= SMALL_BUCKET)
    left, right = few.select("key", F.col("node").alias("a")), few.select(F.col("key").alias("key_b"), F.col("node").alias("b"))
    stars = stars.unionByName(left.join(right, (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b"))).select("a", "b"))
    by_bits = distinct.groupBy("bits").agg(F.min("node").alias("node"))
    close = links(by_bits.select("bits"))
    close = close.join(by_bits.select(F.col("bits").alias("a"), F.col("node").alias("na")), "a").join(by_bits.select(F.col("bits").alias("b"), F.col("node").alias("nb")), "b")
    same_bits = distinct.join(by_bits.withColumnRenamed("node", "na"), "bits").select("na", F.col("node").alias("nb"))
    pairs = stars.unionByName(close.select(F.col("na").alias("a"), F.col("nb").alias("b"))).unionByName(same_bits.select(F.col("na").alias("a"), F.col("nb").alias("b")))
    pairs = cut(close_sketches(pairs, distinct, similarity - MARGIN), "pairs")
    linked = cut(similar_pairs(pairs, shingle_sets(docs, pairs, distinct, doc_id, text, size), similarity), "similar")
    roots = components(linked)
    grouped = large.join(roots, "node", "left").select("node", "key", "m", F.coalesce("root", "node").alias("root"))
    open_keys = grouped.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    opened = cut(grouped.join(open_keys, "key", "left_semi").select("node", "key", "m", "root"), "open")
    if not opened.isEmpty():
        sets = shingle_sets(docs, opened.select(F.col("node").alias("a"), F.col("node").alias("b")), distinct, doc_id, text, size)
        central = cut(close_sketches(centre_pairs(opened), distinct, similarity - MARGIN), "pairs")
        if not central.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(similar_pairs(central, sets, similarity)))
        again = cut(opened.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "again")
        more = cut(close_sketches(prefix_pairs(sets.join(again, "node"), similarity), distinct, similarity - WIDE_MARGIN), "pairs")
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(similar_pairs(more, sets, similarity)))
    rooted = distinct.select("node", "first_id").join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = cut(rooted.join(smallest, "root").select("node", "component_id"), "named")
    return rows.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


@keeps_columns
def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without those similar to one of a smaller id, by groups; rows without id stay, rows of one id stay or go together."""
    groups = similar_groups(docs, doc_id, text, size, similarity)
    losers = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_loser")).distinct()
    return docs.join(losers, F.col(doc_id) == F.col("_loser"), "left_anti")
