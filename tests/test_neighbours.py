import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.operators import neighbours as nb
from ostinato.operators.blocks import cosine_block, top_items

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, m):
    return spark.createDataFrame([(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(m)], SCHEMA)


def exact(df, k):
    e = top_items(df.withColumnRenamed("vec_id", "q"), df, k + 1, cosine_block("embedding"), "q", "vec_id")
    return e.filter("q <> vec_id").select(F.col("q").alias("src"), F.col("vec_id").alias("dst")).join(df.select(F.col("vec_id").alias("src")), "src")


def clustered(rng, clusters, size, dims=32):
    centres = rng.normal(size=(clusters, dims))
    return np.repeat(centres, size, axis=0) + 0.35 * rng.normal(size=(clusters * size, dims))


def test_finds_neighbours_in_clusters(spark):
    df = frame(spark, clustered(np.random.default_rng(1), 200, 12))
    row = nb.recall(df, exact(df, 10), 10, bucket=64).first()
    assert row.recall > 0.9 and row.scored_share < 0.05 and row.met_share < 0.5


def test_work_a_vector_does_not_grow(spark):
    """Twice the rows make twice the pairs met, not four times."""
    rng = np.random.default_rng(2)
    m = rng.normal(size=(4096, 16))
    shares = [nb.recall(frame(spark, m[:n]), spark.createDataFrame([], "src long, dst long"), 5, tables=2, bucket=64).first() for n in (1024, 4096)]
    met = [s.met_share * n * n for s, n in zip(shares, (1024, 4096))]
    assert met[1] < 6 * met[0]


def test_hot_bucket_of_copies(spark, monkeypatch):
    """Vectors that no bit can part are dealt in groups; all still get full lists of equals."""
    rng = np.random.default_rng(3)
    m = np.concatenate([np.repeat(rng.normal(size=(1, 16)), 1500, axis=0), rng.normal(size=(300, 16))])
    df = frame(spark, m)
    monkeypatch.setattr(nb, "MOST_HOT", 4)
    plan = nb.Plan(1800, 16, 5, 2, 3, 64)
    plan.cap = 200
    monkeypatch.setattr(nb, "Plan", lambda *a: plan)
    got = nb.neighbours(df, 5, tables=2, bucket=64)
    counts = {r.src: r.n for r in got.filter("src < 1500 AND score > 0.999").groupBy("src").agg(F.count("*").alias("n")).collect()}
    assert len(counts) == 1500 and min(counts.values()) == 5


def test_sizes_of_the_hashes():
    plan = nb.Plan(100_000, 8, 5, 2, 3, 64)
    assert plan.bits == 10 and nb.Plan(10**9, 8, 5, 2, 3, 256).bits == 21 and nb.Plan(10**12, 8, 5, 2, 3, 256).cap == 10**12 >> 17


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.src, r.dst): r.score for r in nb.neighbours(df, 3).collect()}
    assert {i for pair in got for i in pair} == {0, 1, 4, 6}
    assert got[0, 6] == -1.0 and got[0, 4] == 0.0 and round(got[0, 1], 3) == 0.995
    assert nb.neighbours(spark.createDataFrame([], SCHEMA), 3).collect() == []


@pytest.mark.parametrize("bits", [0, 1, 5])
def test_probes_are_own_key_and_its_doubtful_neighbours(bits):
    rng = np.random.default_rng(bits)
    v = rng.normal(size=(50, 12))
    pr = nb.signs(12, 3 * bits + 64)
    keys, probes, sketch = nb.hash_vectors(v, 3, bits, min(3, bits + 1), pr)
    per = min(3, bits + 1)
    for t in range(3):
        mine = probes[:, t * per:(t + 1) * per]
        assert (mine[:, 0] == keys[:, t]).all()
        assert (np.bitwise_count(mine[:, 1:] ^ keys[:, [t]]) == 1).all()
    assert sketch.shape == (50, 8) and set(np.unique(pr)) <= {-1.0, 1.0}
