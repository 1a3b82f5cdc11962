"""Vector compression to one codebook index a part, by slice and intersect over bitmasks.

Each component x becomes the integer ``floor(factor * x)``; vectors are cut into equal consecutive parts, and each part position has
a codebook of at most 64 entries. A codebook is held sliced: each dimension has the entries' coordinates in rising order and, for each
place in that order, the uint64 mask of the entries before it. A part looks up, in every dimension, the range of coordinates within a radius;
the exclusive or of the two prefix masks is the set of entries in that range, and the sets of all dimensions are intersected. Entries
outside the set are farther away than the radius in one dimension alone, so the nearest entry of the set is the nearest of all when it lies
within the radius. Where the set is empty the radius is doubled; where its nearest entry lies outside, the search is repeated once with that distance
as radius. The first radius is the median distance of an entry to its nearest neighbour. Results are exact, ties go to the lower index.

Codebooks start as the parts of the 64 smallest ids. A round sends one row of sums for each entry and task through a shuffle and
brings ``64 * length`` sums to the driver, whatever the number of rows; codebooks of that size travel with the tasks. All else is one pass of the rows a round.

Nulls and odd rows: vectors that are null or hold null or non-finite components are dropped. The length is that of the smallest id's vector;
vectors of another length, and all vectors if the length is no multiple of the number of parts, stay with null ``code`` and ``error``.
Vectors without components have the code of the first entries. A null id is never among the first 64 (without any id there are no codebooks and all codes are null);
of several vectors of one id the smallest is.
Repeated rows each count and each return. Fewer than 64 ids give smaller codebooks. Components beyond the range of a long are
held at its ends, as are sums of errors; wide values are computed in Python integers. Null labels form one group, of which rows
without an error leave the sum as it is (null if none has one). Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.session import cut

ENTRIES = 64
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Sums of squares of differences below this bound fit into a long.
WIDE = 1 << 62


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def floored(values: np.ndarray, factor: float) -> np.ndarray:
    """``floor(factor * x)`` as longs, held at the ends of their range."""
    scaled = np.floor(values.astype(np.float64) * factor)
    out = np.clip(scaled, -9.2e18, 9.2e18).astype(np.int64)
    for end, beyond in ((LEAST, scaled <= LEAST), (MOST, scaled >= MOST)):
        out[beyond] = end
    rim = (np.abs(scaled) > 9.2e18) & (scaled > LEAST) & (scaled < MOST)
    out[rim] = [int(x) for x in scaled[rim]]
    return out


class Sliced:
    """One part position's codebook: coordinates in rising order a dimension, with masks of the entries before each place."""

    def __init__(self, entries: list[list[int]]):
        self.width, self.n = len(entries[0]), len(entries)
        self.wide = 4 * self.width * max([abs(x) for e in entries for x in e], default=0) ** 2 >= WIDE
        self.entries = np.array(entries, dtype=object if self.wide else np.int64).reshape(self.n, self.width)
        self.coordinates, self.prefixes = [], []
        for d in range(self.width):
            order = sorted(range(self.n), key=lambda j: entries[j][d])
            self.coordinates.append([entries[j][d] for j in order])
            masks = [0]
            for j in order:
                masks.append(masks[-1] | 1 << j)
            self.prefixes.append(np.array(masks, dtype=np.uint64))
        near = sorted(min((sum((a - b) ** 2 for a, b in zip(x, y)) for y in entries if y != x), default=1) for x in entries)
        self.radius = int(near[len(near) // 2] ** 0.5) + 1

    def candidates(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask of the entries within ``radius`` of each part in every dimension."""
        found = np.full(len(parts), self.prefixes[0][-1] if self.width else (1 << self.n) - 1, dtype=np.uint64)
        for d in range(self.width):
            low, high = parts[:, d] - radius, parts[:, d] + radius
            if parts.dtype == object:
                first = np.array([bisect_left(self.coordinates[d], x) for x in low], dtype=np.int64)
                last = np.array([bisect_right(self.coordinates[d], x) for x in high], dtype=np.int64)
            else:
                line = np.array(self.coordinates[d], dtype=np.int64)
                first, last = np.searchsorted(line, low, "left"), np.searchsorted(line, high, "right")
            found &= self.prefixes[d][last] ^ self.prefixes[d][first]
        return found

    def nearest_in(self, parts: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each non-empty mask; entries are met by rising index."""
        index, best = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=parts.dtype)
        live, rest, first = np.arange(len(parts)), masks.copy(), True
        while len(live):
            lowest = rest & (~rest + np.uint64(1))
            j = np.bitwise_count(lowest - np.uint64(1)).astype(np.int64)
            gap = parts[live] - self.entries[j]
            distance = (gap * gap).sum(axis=1)
            better = np.full(len(live), True) if first else distance < best[live]
            index[live[better]], best[live[better]] = j[better], distance[better]
            rest ^= lowest
            stay = rest != 0
            live, rest, first = live[stay], rest[stay], False
        return index, best

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each part (a row each, longs or Python integers)."""
        if not self.wide and parts.dtype != object and len(parts) and 4 * self.width * int(max(abs(int(parts.min(initial=0))), abs(int(parts.max(initial=0))))) ** 2 >= WIDE:
            parts = parts.astype(object)
        if self.wide:
            parts = parts.astype(object)
        index, best = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=parts.dtype)
        open_rows, radius = np.arange(len(parts)), np.full(len(parts), self.radius, dtype=parts.dtype)
        while len(open_rows):
            masks = self.candidates(parts[open_rows], radius)
            some = masks != 0
            rows = open_rows[some]
            index[rows], best[rows] = self.nearest_in(parts[rows], masks[some])
            next_radius = radius * 2
            # a nearest entry outside the radius: one more search as wide as its distance is exact
            next_radius[some] = self.roots(best[rows])
            done = np.full(len(open_rows), False)
            done[some] = best[rows] <= radius[some] * radius[some]
            open_rows, radius = open_rows[~done], next_radius[~done]
        return index, best

    @staticmethod
    def roots(squares: np.ndarray) -> np.ndarray:
        """A whole number at least the square root of each square."""
        if squares.dtype == object:
            return np.array([int(x ** 0.5 * (1 + 1e-9)) + 1 for x in squares], dtype=object)
        return np.ceil(np.sqrt(squares.astype(np.float64)) * (1 + 1e-9)).astype(np.int64) + 1


def rows_of(batch: pa.RecordBatch, length: int, factor: float) -> np.ndarray:
    """The integer vectors of a batch, a row each."""
    values = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return floored(values, factor).reshape(batch.num_rows, length)


def decimals(values: list[int]) -> pa.Array:
    return pa.array(values, type=pa.decimal128(38, 0))


def one_round(rows: DataFrame, books: list[list[list[int]]], length: int, factor: float) -> list[list[list[int]]]:
    """The codebooks whose entries are the floored means of their parts; unused entries stay."""
    parts, width = len(books), length // len(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sliced = [Sliced(b) for b in books]
        total, count = {}, {}
        for batch in batches:
            vectors = rows_of(batch, length, factor)
            for p, book in enumerate(sliced):
                cells = vectors[:, p * width:(p + 1) * width]
                index, _ = book.nearest(cells)
                used = np.bincount(index, minlength=book.n)
                # halves of the longs are summed apart, so sums of a batch cannot overflow
                low, high = cells & 0xFFFFFFFF, cells >> 32
                for j in np.flatnonzero(used).tolist():
                    mine = index == j
                    count[p, j] = count.get((p, j), 0) + int(used[j])
                    add = [int(h) * (1 << 32) + int(x) for h, x in zip(high[mine].sum(axis=0), low[mine].sum(axis=0))]
                    total[p, j] = [a + b for a, b in zip(total[p, j], add)] if (p, j) in total else add
        if count:
            keys = sorted(count)
            flat = decimals([x for k in keys for x in total[k]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([count[k] for k in keys], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(range(0, len(keys) * width + 1, width) if width else [0] * (len(keys) + 1), pa.int32()), flat)],
                names=["part", "entry", "n", "total"])

    found = rows.select("v").mapInArrow(sums, "part int, entry int, n long, total array<decimal(38,0)>")
    added = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]).cast("decimal(38,0)") for i in range(width)]).alias("total"))
    out = [[list(e) for e in b] for b in books]
    for r in added.toLocalIterator():
        out[r.part][r.entry] = [int(x) // r.n for x in r.total]
    return out


def first_books(rows: DataFrame, parts: int, length: int, factor: float) -> list[list[list[int]]]:
    """Codebooks of the vectors of the smallest ids; each task hands on its smallest ids only."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, schema = {}, None
        for batch in batches:
            schema, bound = batch.schema, max(kept) if len(kept) == ENTRIES else None
            ids = batch.column("id").to_pylist()
            near = [i for i, x in enumerate(ids) if bound is None or x <= bound]
            for i, v in zip(near, batch.column("v").take(pa.array(near, pa.int64())).to_pylist()):
                kept[ids[i]] = min(kept.get(ids[i], v), v)
            kept = {x: kept[x] for x in sorted(kept)[:ENTRIES]}
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(kept, schema.field("id").type), pa.array(kept.values(), schema.field("v").type)], names=["id", "v"])

    kinds = dict(rows.dtypes)
    found = rows.where("id IS NOT NULL").select("id", "v").mapInArrow(smallest, f"id {kinds['id']}, v {kinds['v']}")
    first = found.groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(ENTRIES).collect()
    vectors = [floored(np.array(r.v, dtype=np.float64), factor).tolist() for r in first]
    width = length // parts
    return [[v[p * width:(p + 1) * width] for v in vectors] for p in range(parts)]


def encode(rows: DataFrame, books: list[list[list[int]]], length: int, factor: float) -> DataFrame:
    """``id, label, code, error`` of ``rows`` (id, label, v) of the codebooks' length."""
    parts, width = len(books), length // len(books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sliced = [Sliced(b) for b in books]
        for batch in batches:
            vectors = rows_of(batch, length, factor)
            found = [book.nearest(vectors[:, p * width:(p + 1) * width]) for p, book in enumerate(sliced)]
            index = np.stack([f[0] for f in found], axis=1).astype(np.uint8).tobytes().hex()
            error = [min(MOST, sum(x)) for x in zip(*[f[1].tolist() for f in found])]
            step = 2 * parts
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([index[i * step:(i + 1) * step] for i in range(batch.num_rows)], pa.string()), pa.array(error, pa.int64())],
                names=["id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select("id", "label", "v").mapInArrow(codes, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def books_digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, rounds: int = 2, id_column: str = "vec_id", label: str = "label", vector: str = "embedding",
             factor: float = 256.0) -> tuple[DataFrame, list[list[list[int]]]]:
    """``vec_id, label, code, error`` of every usable row, and the codebooks (part, entry, component)."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).where(usable("v"))
    first = rows.where("id IS NOT NULL").agg(F.min(F.struct("id", "v"))["v"].alias("v")).first().v
    length = len(first or [])
    unfit = (F.size("v") != length) | F.lit(first is None or length % parts > 0)
    fit, books = rows.where(~unfit), []
    none = rows.where(unfit).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if first is not None and length % parts == 0:
        books = first_books(fit, parts, length, factor)
        books = reduce(lambda b, _: one_round(fit, b, length, factor), range(rounds if length else 0), books)
        none = encode(fit, books, length, factor).unionByName(none)
    return none.select(F.col("id").alias("vec_id"), "label", "code", "error"), books


def digest(codes: DataFrame, books: list[list[list[int]]]) -> DataFrame:
    """Rows of the query: errors summed over equal labels join the codes again; one hot label's rows may be split."""
    codes = cut(codes, "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    total = F.when(total.isNotNull(), F.least(total, F.lit(MOST).cast("decimal(38,0)"))).cast("long")
    labels = codes.groupBy(F.col("label").alias("l")).agg(total.alias("label_error"))
    return codes.join(labels, codes.label.eqNullSafe(labels.l)).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


#: The same by comparing every part with every entry.
ORACLE = """
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS (SELECT r, vec_id, p, list_slice(e, p * (len(e) // 16) + 1, (p + 1) * (len(e) // 16)) AS v FROM kept, (SELECT unnest(range(16)) AS p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, v FROM cells QUALIFY j < 64),
a0 AS (SELECT r, c.p, any_value(c.v) AS v, min(list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + j) AS d
  FROM cells c JOIN b0 b ON c.p = b.p GROUP BY r, c.p),
m0 AS (SELECT p, j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
  SELECT p, d % 64 AS j, i, sum(v[i]) AS s, count(*) AS n FROM a0, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM cells))) AS i) GROUP BY ALL) GROUP BY p, j),
b1 AS (SELECT p, j, coalesce(list_transform(m0.v, lambda x: CAST(x AS BIGINT)), b0.v) AS v FROM b0 LEFT JOIN m0 USING (p, j)),
a1 AS (SELECT r, c.p, any_value(c.v) AS v, min(list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + j) AS d
  FROM cells c JOIN b1 b ON c.p = b.p GROUP BY r, c.p),
m1 AS (SELECT p, j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
  SELECT p, d % 64 AS j, i, sum(v[i]) AS s, count(*) AS n FROM a1, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM cells))) AS i) GROUP BY ALL) GROUP BY p, j),
b2 AS (SELECT p, j, coalesce(list_transform(m1.v, lambda x: CAST(x AS BIGINT)), b1.v) AS v FROM b1 LEFT JOIN m1 USING (p, j)),
a2 AS (SELECT r, c.p, min(list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + j) AS d
  FROM cells c JOIN b2 b ON c.p = b.p GROUP BY r, c.p),
coded AS (SELECT r, string_agg(printf('%02x', d % 64), '' ORDER BY p) AS code, CAST(sum(d // 64) AS BIGINT) AS error FROM a2 GROUP BY r),
books AS (SELECT sha256(string_agg(list_aggregate(v, 'string_agg', ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), books"""
