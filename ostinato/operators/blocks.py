"""Exact nearest items by blocks: dense scoring inside a task, only the best rows leave it."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.operators.shape import ranked
from ostinato.session import cut

BLOCK_ROWS = 8192
#: Tasks of one pass; beyond it a task walks several block pairs, so that the driver's task table stays small.
MAX_TASKS = 20_000

CHUNK = 256
#: Query rows scored at a time, so a task holds CHUNK_ROWS * BLOCK_ROWS scores at most.
CHUNK_ROWS = 512


def cogroup_blocks(left: DataFrame, right: DataFrame, keys: list[str], blocks: int, fn: Callable, schema: str) -> DataFrame:
    """Run ``fn`` on each pair of blocks, one task per pair as far as possible.

    The number of tasks is set by hand: blocks are few bytes but much work, so joining small
    partitions, as the adaptive planner would, is wrong here.
    """
    n = max(1, min(blocks, MAX_TASKS))
    a, b = (df.repartition(n, *keys).groupBy(*keys) for df in (left, right))
    return a.cogroup(b).applyInPandas(fn, schema)


def _best(scores, ids, k, digits, exclude=None, floor=None):
    """Row-wise best k columns by (rounded score desc, id asc); returns row numbers, column numbers, scores."""
    import numpy as np

    if scores.shape[1] == 0 or k == 0:
        return np.array([], int), np.array([], int), np.array([])
    id_rank = np.empty(len(ids), dtype=np.int64)
    id_rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    found = [
        _best_rows(scores[at:at + CHUNK], id_rank, k, digits, None if exclude is None else exclude[at:at + CHUNK], floor, at)
        for at in range(0, len(scores), CHUNK)
    ]
    return tuple(np.concatenate(x) for x in zip(*found))


def _best_rows(s, id_rank, k, digits, exclude, floor, offset):
    """The same for a few rows, small enough to stay in cache."""
    import numpy as np

    if exclude is not None:
        s = np.where(exclude, -np.inf, s)
    m = s.shape[1]
    if k < m:
        # rounding keeps the order, so all rounded scores that can reach the k-th lie above this line
        kth = np.partition(s, m - k, axis=1)[:, m - k]
        rows, cols = np.nonzero(s >= (kth - 2 * 10.0 ** -digits)[:, None])
    else:
        rows, cols = np.nonzero(np.isfinite(s))
    vals = np.round(s[rows, cols], digits)
    ok = np.isfinite(vals) if floor is None else np.isfinite(vals) & (vals >= floor)
    rows, cols, vals = rows[ok], cols[ok], vals[ok]
    o = np.lexsort((id_rank[cols], -vals, rows))
    rows, cols, vals = rows[o], cols[o], vals[o]
    place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(s)))[rows]
    first = place < k
    return rows[first] + offset, cols[first], vals[first]


def packed(batches, rows: int):
    """Arrow batches as rows ``(n, blob)`` of at most ``rows`` rows each, in the stream format of Arrow."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part, sink = batch.slice(at, rows), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_batch(pa.RecordBatch.from_pydict({n: pa.concat_arrays([c]) for n, c in zip(part.schema.names, part.columns)}, schema=part.schema))
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["n", "blob"])


def unpacked(blob):
    """The rows of a blob as a pandas frame."""
    import pyarrow as pa

    return pa.ipc.open_stream(blob).read_pandas()


def numbered_blocks(df: DataFrame, key: str, rows: int, name: str) -> tuple[DataFrame, int]:
    """Hash blocks of about ``rows`` rows as stored blobs ``(name, blob)``, and their number."""
    n = max(1, math.ceil(df.count() / rows))

    def pack(table):
        import pyarrow as pa

        own = table.drop_columns([name])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema) as out:
            out.write_table(own)
        return pa.table({name: pa.array([table.column(name)[0].as_py()], pa.int32()), "blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    block = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    return cut(df.withColumn(name, block).groupBy(name).applyInArrow(pack, f"{name} int, blob binary"), "packed"), n


def top_items(
    queries: DataFrame, items: DataFrame, k: int, score: Callable, query_id: str, item_id: str, digits: int = 6,
    exclude_same: bool = False, min_score: float | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For each query the k best items: ``(query_id, item_id, score, rank)``, ties by item id.

    ``score(query_pdf, item_pdf)`` gives the dense score block of two pandas frames.  Queries are stored as hash blocks, items are packed
    where they are read, both as one binary row a block, and meet by an equi-join on the query block; the planner may broadcast the query blocks
    when their stored size is small.  Queries of one block leave the items where they are; for more, each pair of blocks is dealt to a task of its own.
    A pair of blocks is scored some hundred queries at a time and leaves at most k rows per query.
    """
    out_item = item_id if item_id != query_id else "item_id"
    qt, it = queries.schema[query_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    asked, n = numbered_blocks(queries, query_id, block_rows, "_qb")
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_qb")
    blobs = items.mapInArrow(lambda batches: packed(batches, block_rows), "n int, blob binary").select("n", F.col("blob").alias("_items"), every)
    if n > 1:
        tasks = min(MAX_TASKS, n * max(1, math.ceil(items.count() / block_rows)))
        blobs = blobs.repartition(tasks, "_qb", F.xxhash64("_items"))

    def best(batches):
        import numpy as np
        import pyarrow as pa

        shape = pa.schema([("query_id", types[0]), ("item_id", types[1]), ("score", pa.float64())])
        for batch in batches:
            for at in range(batch.num_rows):
                q, i = (unpacked(batch.column(c)[at].as_buffer()) for c in ("blob", "_items"))
                for first in range(0, len(q), CHUNK_ROWS):
                    part = q.iloc[first:first + CHUNK_ROWS]
                    same = part[query_id].to_numpy()[:, None] == i[item_id].to_numpy()[None, :] if exclude_same else None
                    r, c, v = _best(score(part, i), i[item_id].to_numpy(), k, digits, same, min_score)
                    found = [pa.array(part[query_id].to_numpy()[r], types[0]), pa.array(i[item_id].to_numpy()[c], types[1]), pa.array(np.asarray(v, float))]
                    yield pa.RecordBatch.from_arrays(found, schema=shape)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(queries.schema[query_id].dataType), to_arrow_type(items.schema[item_id].dataType)]
    partial = blobs.join(asked, "_qb").select("blob", "_items").mapInArrow(best, f"query_id {qt}, item_id {it}, score double")
    top = ranked(partial, ["query_id"], [F.desc("score"), F.asc("item_id")], k)
    return top.select(F.col("query_id").alias(query_id), F.col("item_id").alias(out_item), "score", "rank")


def top_within(
    items: DataFrame, keys: list[str], k: int, score: Callable, item_id: str, digits: int = 6, block_rows: int = 1024,
    queries: DataFrame | None = None,
) -> DataFrame:
    """For each query the k best items with the same keys, itself included: ``(query_id, item_id, score, rank)``.

    Queries are some rows of the items (by default all).  A large class is cut into blocks, so it is many tasks; each task
    returns at most k rows per query.
    """
    queries = items if queries is None else queries
    id_type = items.schema[item_id].dataType.simpleString()

    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]).agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))

    shared = [f"_k{i}" for i in range(len(keys))]
    both = cut(sizes(queries, "_lbs").join(sizes(items, "_rbs"), shared), "classes")
    tasks = both.agg(F.coalesce(F.sum(F.col("_lbs").cast("long") * F.col("_rbs")), F.lit(0))).first()[0]
    same = reduce(lambda a, b: a & b, [F.col(f"_k{i}").eqNullSafe(F.col(c)) for i, c in enumerate(keys)])

    def placed(df: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))
        cols = [F.col(c).alias(c) for c in [*shared, *df.columns]]  # renewed, as both sides come from the same frames
        return df.join(both, same).select(F.pmod(F.xxhash64(item_id), F.col(n_own)).cast("int").alias(own), every.alias(other), *cols)

    def block(q, i):
        import numpy as np
        import pandas as pd

        if q.empty or i.empty:
            none = (q if i.empty else i)[item_id].iloc[:0]
            return pd.DataFrame({"query_id": none, "item_id": none, "score": np.array([], float)})
        r, c, v = _best(score(q, i), i[item_id].to_numpy(), k, digits)
        return pd.DataFrame({"query_id": q[item_id].to_numpy()[r], "item_id": i[item_id].to_numpy()[c], "score": v})

    partial = cogroup_blocks(placed(queries, "_lb", "_lbs", "_rb", "_rbs"), placed(items, "_rb", "_rbs", "_lb", "_lbs"), [*shared, "_lb", "_rb"], tasks, block,
                             f"query_id {id_type}, item_id {id_type}, score double")
    return ranked(partial, ["query_id"], [F.desc("score"), F.asc("item_id")], k)


def matrix(col):
    """Column of equal-length number lists as a float64 matrix."""
    import numpy as np

    return np.stack(col.to_numpy()).astype(np.float64)


def cosine_block(vector: str) -> Callable:
    def score(q, i):
        import numpy as np

        a, b = matrix(q[vector]), matrix(i[vector])
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        d = a @ b.T
        n = na[:, None] * nb[None, :]
        return np.divide(d, n, out=np.zeros_like(d), where=n > 0)

    return score
