import math

import numpy as np
from pyspark.sql import functions as F

from ostinato.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, every=50):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good[i, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    out = {}
    for q, a in good:
        if q % every == 0:
            scores = sorted((-max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in good if i != q and len(a) == len(b))
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def searched(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA).withColumn("score", F.lit("x")).withColumn("query_id", F.lit(0))
    out = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, **kw).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def check(spark, rows, **kw):
    assert searched(spark, rows, **kw) == {q: v for q, v in brute(rows).items() if v}


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=20).astype(np.float32).tolist()) for i in range(400)]
    check(spark, rows, block_rows=64, query_rows=3, step=4)
    check(spark, rows, step=7)


def test_ties_copies_and_bad_vectors(spark):
    same = [0.5, -0.25, 0.125]
    rows = [(i, same) for i in range(0, 120)] + [(50, same), (200, None), (250, []), (300, [1.0, None, 2.0]), (350, [float("nan"), 1.0, 1.0]),
                                                (400, [float("inf"), 1.0, 1.0]), (450, [1.0, 2.0]), (451, [2.0, 1.0]), (None, same)]
    check(spark, rows, block_rows=16, query_rows=2)


def test_few_and_huge(spark):
    check(spark, [(0, [1.0]), (3, [2.0])])
    check(spark, [(0, [1e30, 2.0]), (1, [1e30, -3.0]), (2, [-1e30, 1.0]), (50, [5e8, 5e8]), (51, [5e8, 5e8])])
    check(spark, [(50, [1.0, 2.0])])
    assert searched(spark, []) == {}
