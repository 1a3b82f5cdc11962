"""Exact top-k inner-product search by columnar branch and bound.

Vectors are packed in blocks whose layout is vertical: one row a dimension. A task meets one block of queries with one
block of candidates. For each query it adds the products of one block of dimensions after another; after each, a candidate
survives only if its sum so far plus the bound of the rest (Cauchy-Schwarz on the remaining norms of query and candidate)
can still reach the query's k-th best score. Survivors are compacted, so later dimensions are read for few candidates.
The k best of each block meet in a top-k window for each query.

Queries are a stated part of the rows. Blocks of queries and candidates meet by an equi-join on block numbers, so neither
side is broadcast or collected; block sizes are fixed, and the number of blocks grows with the rows.

Vectors that are null, empty or hold null or non-finite components take no part; only vectors of equal length are compared.
Equal rows count once. Ties go to the smaller id. Scores are exact; a score beyond the range of a long is held at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.session import cut

LEAST, MOST = -(1 << 63), (1 << 63) - 1
PACKED = "dims int, block int, n int, ids binary, columns binary"


def scaled(vector: str, factor: float) -> Column:
    """``factor * x`` of each component as doubles; null for vectors that take no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when((F.size(vector) > 0) & ~bad, F.transform(vector, lambda x: x.cast("double") * F.lit(factor)))


def pack(frame: pd.DataFrame, block: tuple) -> pd.DataFrame:
    """One block: ids in rising order and the floored components, a row a dimension."""
    frame = frame.sort_values("id", kind="stable")
    rows = np.floor(np.array(frame["v"].tolist(), dtype=np.float64))
    return pd.DataFrame({"dims": [block[0]], "block": [block[1]], "n": [len(frame)], "ids": [frame["id"].to_numpy(np.int64).tobytes()],
                         "columns": [np.ascontiguousarray(rows.T).tobytes()]})


def packed_blocks(rows: DataFrame, n: int, size: int) -> DataFrame:
    """``rows`` (id, v) in about ``n / size`` blocks of equal vector length."""
    blocks = max(1, -(-n // size))

    def pack_group(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pack(frame, key)

    numbered = rows.select(F.size("v").alias("dims"), F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), "id", "v")
    return numbered.groupBy("dims", "block").applyInPandas(pack_group, PACKED)


def rest_norms(columns: np.ndarray, step: int) -> np.ndarray:
    """Norm of what remains of each vector after 0, step, 2 * step ... dimensions; slightly raised against rounding."""
    squares = np.add.reduceat(columns * columns, range(0, len(columns), step), axis=0)
    rest = np.concatenate([np.cumsum(squares[::-1], axis=0)[::-1], np.zeros((1, columns.shape[1]))])
    return np.sqrt(rest) * (1 + 1e-9)


def exact_scores(query: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Integer inner products as Python integers, held in the range of a long."""
    return np.array([min(MOST, max(LEAST, sum(int(a) * int(b) for a, b in zip(query, c)))) for c in columns.T], dtype=np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= kth)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def search_block(query_ids, queries, ids, columns, k: int, step: int, first: int = 256) -> Iterator[tuple[int, int, int]]:
    """(query id, id, score) of the k best candidates of one block for each query; arrays hold a row a dimension."""
    dims = len(columns)
    # sums of doubles are exact below 2**53; longer products are done in Python integers
    small = float(np.abs(queries).max(initial=0)) * float(np.abs(columns).max(initial=0)) * dims < 2.0 ** 52
    q_rest, c_rest = rest_norms(queries, step), rest_norms(columns, step)
    for i, qid in enumerate(query_ids.tolist()):
        q = queries[:, i]
        if not small:
            live = np.flatnonzero(ids != qid)
            scores = exact_scores(q, columns[:, live])
        else:
            head = np.flatnonzero(ids[:first] != qid)
            start = q @ columns[:, head]
            floor = np.partition(start, len(start) - k)[len(start) - k] if len(start) >= k else -np.inf
            live = np.flatnonzero(ids != qid)
            scores = np.zeros(len(live))
            for b, at in enumerate(range(0, dims, step)):
                part = columns[at:at + step] if b == 0 and len(live) == len(ids) else columns[at:at + step, live]
                scores = scores + q[at:at + step] @ part
                stay = scores + q_rest[b + 1, i] * c_rest[b + 1, live] >= floor
                if not stay.all():
                    live, scores = live[stay], scores[stay]
        for j in best(scores, ids[live], k):
            yield qid, int(ids[live[j]]), int(scores[j])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", factor: float = 256.0,
          step: int = 8, block_rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of ``floor(factor * x)`` for each query against all other rows."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), scaled(vector, factor).alias("v"), is_query.alias("q"))
    rows = cut(rows.where("v IS NOT NULL AND id IS NOT NULL").groupBy("id", "v").agg(F.max("q").alias("q")), "vectors")
    n, queries = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("q"), 1))).first()
    candidates = packed_blocks(rows, n, block_rows)
    asked = packed_blocks(rows.where("q"), queries, query_rows)
    query_blocks = max(1, -(-queries // query_rows))
    spread = candidates.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = asked.select(F.col("dims").alias("q_dims"), F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("n").alias("q_n"), F.col("columns").alias("q_columns"))
    pairs = spread.join(asked, (spread.dims == asked.q_dims) & (spread.query_block == asked.q_block))
    pairs = pairs.repartition(max(1, -(-n // block_rows)) * query_blocks, "block", "query_block")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                shape, q_shape = (row.dims, row.n), (row.dims, row.q_n)
                found = list(search_block(np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.q_columns).reshape(q_shape),
                                          np.frombuffer(row.ids, np.int64), np.frombuffer(row.columns).reshape(shape), k, step))
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = pairs.mapInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


#: The same rows from all products.
ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0) WHERE rank <= 5"""
