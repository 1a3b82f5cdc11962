import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.operators import blocks, evaluate, explain, rerank, semantic, similarity
from ostinato.operators.features import Weights, catalog_flags, feature_rows, key_vector, tag_tfidf
from ostinato.session import cut


@pytest.fixture(scope="module")
def catalogue(spark):
    rng = random.Random(3)
    keys = ["C major", "A minor", "F♯ minor", "E♭ major", None, "Q major"]
    works = [(i, rng.choice([None, 1, 2, 3]), f"t{i}", rng.choice(["Sonata", "Mass", None]), rng.choice(["Op. 1", "BWV 2", "K. 3", None]), rng.choice(keys)) for i in range(70)]
    comps = [(1, "A", "Baroque", "DE"), (2, "B", "Baroque", "AT"), (3, "C", "Romantic", None)]
    tags = [(w[0], rng.choice(["solo-piano", "dark", "full-orchestra", "lyrical"]), "m") for w in works for _ in range(rng.randrange(3))]
    w = spark.createDataFrame(works, "work_id int, composer_id int, title string, work_type string, catalog_number string, key string")
    c = spark.createDataFrame(comps, "composer_id int, name string, period string, country string")
    g = spark.createDataFrame(tags, "work_id int, tag string, source string")
    vectors, vocabulary = tag_tfidf(w, g)
    return w, c, g, cut(feature_rows(w, c, vectors)), vectors, vocabulary


def dense_vectors(rows, w=Weights()):
    """Explicit weighted one-hot vectors, column by column."""
    rows = sorted((r.asDict() for r in rows.collect()), key=lambda r: r["work_id"])
    cols = {}

    def col(name):
        return cols.setdefault(name, len(cols))

    cells = []
    for r in rows:
        x = {("n", r["name"]): w.composer, ("p", r["period"]): w.period, ("t", r["work_type"]): w.work_type, ("c", r["country"]): w.country,
             ("pt", r["period"], r["work_type"]): w.composite, ("pk", r["period"], r["key"]): w.composite}
        if r["key_pos"] is not None:
            x["sin"], x["cos"] = math.sin(2 * math.pi * r["key_pos"] / 12), math.cos(2 * math.pi * r["key_pos"] / 12)
        x |= {("tag", t): w.tags * v for t, v in zip(r["terms"], r["weights"])}
        x |= {("flag", b): w.catalog for b in range(8) if r["flags"] >> b & 1}
        cells.append({col(k): v for k, v in x.items()})
    m = np.zeros((len(rows), len(cols)))
    for i, x in enumerate(cells):
        for j, v in x.items():
            m[i, j] = v
    return [r["work_id"] for r in rows], m


def scores(m, metric):
    d = m @ m.T
    n = np.linalg.norm(m, axis=1)
    if metric == "dot":
        return d
    if metric == "cosine":
        return d / n[:, None] / n[None, :]
    if metric == "euclidean":
        return 1 / (1 + np.sqrt(np.maximum(n[:, None] ** 2 + n[None, :] ** 2 - 2 * d, 0)))
    return 1 / (1 + np.abs(m[:, None, :] - m[None, :, :]).sum(axis=2))


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan", "dot"])
def test_edges_equal_explicit_vectors(catalogue, metric):
    ids, m = dense_vectors(catalogue[3])
    s = scores(m, metric)
    got = {}
    for r in similarity.all_edges(catalogue[3], 5, metric).collect():
        got.setdefault(r.src, []).append((r.rank, r.dst, r.score))
    for i, w in enumerate(ids):
        mine = sorted(got[w])
        assert [r[0] for r in mine] == [1, 2, 3, 4, 5] and all(r[1] != w for r in mine)
        best = np.sort(np.delete(s[i], i))[::-1][:5]
        assert np.allclose([r[2] for r in mine], best, atol=2e-6)
        assert all(abs(s[i, ids.index(r[1])] - r[2]) < 2e-6 for r in mine)


def test_one_seed_and_pairs_agree_with_edges(catalogue, spark):
    rows = catalogue[3]
    edges = similarity.all_edges(rows, 5).filter("src = 7").orderBy("rank").collect()
    one = similarity.similar_to(rows, 7, 5).orderBy("rank").collect()
    assert [(r.dst, r.score) for r in edges] == [(r.work_id, r.score) for r in one]
    pairs = spark.createDataFrame([(7, r.dst) for r in edges], "src int, dst int")
    assert {r.dst: r.cosine for r in similarity.score_pairs(pairs, rows).collect()} == {r.dst: r.score for r in edges}
    with pytest.raises(ValueError, match="Work ID not found"):
        similarity.similar_to(rows, 12345)
    with pytest.raises(ValueError, match="No works found"):
        similarity.similar_to_title(rows, catalogue[0], "zzz")
    few = similarity.similar_to(rows, 7, 70, max_same_composer=2).join(rows.select("work_id", "name"), "work_id")
    assert few.groupBy("name").count().agg(F.max("count")).first()[0] <= 2


def test_copies_are_one_profile(spark, catalogue):
    """A third of the rows are copies of one work; the edges stay whole and exact."""
    rows = catalogue[3].filter("work_id < 20")
    one = rows.filter("work_id = 3")
    copies = one.drop("work_id").join(spark.range(1000, 1400).withColumnRenamed("id", "work_id").withColumn("work_id", F.col("work_id").cast("int")), F.lit(True)).select(rows.columns)
    both = rows.unionByName(copies)
    e = similarity.all_edges(both, 4)
    assert e.groupBy("src").count().agg(F.min("count"), F.max("count"), F.count("*")).first()[:] == (4, 4, 420)
    got = [r.dst for r in e.filter("src = 1005").orderBy("rank").collect()]
    assert got == [3, 1000, 1001, 1002]
    assert [r.dst for r in e.filter("src = 1001").orderBy("rank").collect()] == [3, 1000, 1002, 1003]


def test_block_strategies_agree(spark):
    rng = np.random.default_rng(0)
    v = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(150)] + [(200 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(20)]
    df = spark.createDataFrame(v, "id int, v array<double>")
    a = blocks.top_items(df, df, 7, blocks.cosine_block("v"), "id", "id", exclude_same=True)
    b = blocks.top_items(df, df, 7, blocks.cosine_block("v"), "id", "id", exclude_same=True, block_rows=40)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.count() == 170 * 7


def test_search_thresholds(spark):
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.5, 0.5])], "vec_id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    assert [r.vec_id for r in semantic.search(q, items, 10, 0.9).collect()] == ["a"]
    assert [r.vec_id for r in semantic.search(q, items, 10, 0.15).orderBy("rank").collect()] == ["a", "c"]
    assert [r.vec_id for r in semantic.search_one([1.0, 0.0], items).orderBy("rank").collect()] == ["a", "c"]
    assert semantic.search(q.limit(0), items).columns == ["query_id", "vec_id", "score", "rank"]
    h = semantic.hybrid(q.withColumn("seed_id", F.lit("b")), items, 3, 0.5).orderBy("rank").collect()
    assert [r.vec_id for r in h] == ["c", "a"]
    with pytest.raises(ValueError, match="Work ID not found"):
        semantic.hybrid(q.withColumn("seed_id", F.lit("zz")), items)


def test_diverse(catalogue):
    rows = catalogue[3]
    plain = [r.work_id for r in similarity.similar_to(rows, 7, 6).orderBy("rank").collect()]
    got = rerank.diverse(rows, [7, 9], 6, 1.0)
    assert [r.item_id for r in got.filter("seed_id = 7").orderBy("rank").collect()] == plain
    ids, m = dense_vectors(rows)
    s = scores(m, "cosine")
    for w in (0.0, 0.3):
        picks, pool = [], [i for i in range(len(ids)) if ids[i] != 7]
        i7 = ids.index(7)
        for _ in range(6):
            best = max(pool, key=lambda i: (round(w * s[i7, i] - (1 - w) * max((s[i, p] for p in picks), default=0.0), 6), -ids[i]))
            picks.append(best)
            pool.remove(best)
        mine = [r.item_id for r in rerank.diverse(rows, [7], 6, w).orderBy("rank").collect()]
        assert mine == [ids[p] for p in picks]
    assert rerank.diverse(rows.filter("work_id < 4"), [1], 10).count() == 3
    with pytest.raises(ValueError):
        rerank.diverse(rows, [999], 2)


def test_sampling_is_by_score(spark):
    """Over 2,000 keys the first draws follow the scores (within three standard deviations)."""
    n = 2000
    rows = spark.range(n).select(F.col("id").alias("k"), F.explode(F.array(*[F.struct(F.lit(i).alias("item"), F.lit(s).alias("score")) for i, s in enumerate([0.4, 0.3, 0.2, 0.1])])).alias("x")).select("k", "x.*")
    got = Counter(r.item for r in rerank.sample_by_score(rows, 1, "k", "item", multiplier=4).collect())
    for i, p in enumerate([0.4, 0.3, 0.2, 0.1]):
        assert abs(got[i] - n * p) < 3 * math.sqrt(n * p * (1 - p))
    a = rerank.sample_by_score(rows, 2, "k", "item", seed=1)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, rerank.sample_by_score(rows, 2, "k", "item", seed=1).collect()))
    assert a.count() == 2 * n


def test_gini(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 5), (2, 1), (2, 9)], "g int, x int")
    got = {r.g: r.gini for r in evaluate.gini(df, "x", ["g"]).collect()}
    assert abs(got[1]) < 1e-12 and abs(got[2] - 0.4) < 1e-12


def test_pair_moments_and_histogram(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(90, 5))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id int, embedding array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = (u @ u.T)[np.triu_indices(90, 1)]
    r = semantic.pair_moments(df).first()
    assert abs(r["mean"] - s.mean()) < 1e-9 and abs(r["std"] - s.std()) < 1e-9
    h = semantic.pair_histogram(df, block_rows=25)
    assert h.agg(F.sum("n")).first()[0] == 90 * 89 // 2
    q = semantic.histogram_quantiles(h, q25=0.25, median=0.5).first()
    assert np.allclose([q["min"], q["max"], q.q25, q.median], [s.min(), s.max(), np.quantile(s, 0.25), np.median(s)], atol=2e-6)


def test_key_circle(spark):
    df = spark.createDataFrame([("C major",), ("A minor",), ("G major",), ("F♯ major",), ("Q",)], "k string")
    got = [tuple(round(x, 6) for x in r) for r in df.select(*key_vector(F.col("k"))).collect()]
    assert got[0] == got[1] == (0.0, 1.0) and got[2] == (0.5, 0.866025) and got[3] == (0.0, -1.0) and got[4] == (0.0, 0.0)
    f = spark.createDataFrame([("Op. 9",), ("BWV 1, Op. 2",), ("WoO 3",), ("",)], "c string")
    assert [r[0] for r in f.select(catalog_flags(F.col("c"))).collect()] == [1, 3, 64, 0]


def test_sentences(spark):
    df = spark.createDataFrame([(["sad"],), (["sad", "lonely"],), (["sad", "lonely", "dark"],), ([],)], "a array<string>")
    assert [r[0] for r in df.select(explain.join_words(F.col("a"))).collect()] == ["sad", "sad and lonely", "sad, lonely, and dark", ""]
    rows = [
        ("sad e minor music", "Symphony in E minor", "E minor", "symphony", "Romantic", ["dramatic"]),
        ("lonely romantic", "x", "E minor", "nocturne", "Romantic", None),
        ("dramatic please", "x", None, "opera", None, ["dramatic", "famous"]),
        ("nothing", "x", None, None, None, None),
        ("nothing", "x", "F♯ minor", "sonata", "Baroque", ["famous", "dark"]),
        ("in g major", "Partita in G major / Partita in E minor", None, None, None, None),
    ]
    out = [r.explanation for r in explain.explain_results(spark.createDataFrame(rows, "query string, title string, key string, work_type string, period string, tags array<string>")).collect()]
    assert out == [
        "Sad and lonely in e minor, a symphony", "A Romantic nocturne that's lonely in E minor", "Featuring dramatic character",
        "A piece that matches the mood you're looking for", "A Baroque sonata with sad and mysterious (F# minor) and dark character",
        "Joyful and energetic in g major",
    ]


def test_expansion(spark):
    df = spark.createDataFrame([("Studying",), ("sad girl autumn",), ("plain",)], "q string")
    got = [r[0] for r in df.select(semantic.expand_query(F.col("q"))).collect()]
    assert got[0].startswith("Studying calm focused") and got[2] == "plain"
    assert got[1].split(" ")[3] == "melancholic" and got[1].endswith("gentle sorrowful")
    k = spark.createDataFrame([("e MINOR",), ("X major",), ("X minor",), ("none",)], "k string")
    assert [r[0].split(" ")[0] for r in k.select(semantic.key_moods(F.col("k"))).collect()] == ["sad", "bright", "melancholic", ""]


def test_large_composer_is_final_without_others(spark, catalogue):
    """Composers with many close works need no comparison with others; the lists are those of the full comparison."""
    rows = catalogue[3]
    m = spark.range(1, 6).withColumnRenamed("id", "m")
    more = rows.filter("name = 'A'").join(m, F.lit(True)).withColumn("work_id", (F.col("work_id") + 100 * F.col("m")).cast("int"))
    more = more.withColumn("nf", F.pmod(F.col("work_id"), F.lit(16)).cast("int"))
    more = more.withColumn("norm2", F.col("norm2") + (F.bit_count("nf") - F.bit_count("flags")) * 0.25)
    more = more.withColumn("flags", F.col("nf")).select(rows.columns)
    both = cut(rows.unionByName(more))
    _members, distinct = similarity.profiles(both, 6)
    distinct = cut(distinct.drop("ids"))
    fast = similarity.near_profiles(distinct, 6, "cosine", Weights())
    full = blocks.top_items(distinct, distinct, 6, similarity.content_block(), "profile_id", "profile_id")
    assert sorted(map(tuple, fast.select(full.columns).collect())) == sorted(map(tuple, full.collect()))
    inside = blocks.top_within(distinct, ["name"], 6, similarity.content_block(), "profile_id", block_rows=30)
    line = similarity.class_bound((("name",),), "cosine", Weights(), 9.25)
    assert abs(line - 37 / 62) < 1e-9 and inside.filter((F.col("rank") == 6) & (F.col("score") > line)).count() > 0


@pytest.fixture(scope="module")
def small_composers(spark):
    """900 works of 400 composers, one to four works each, in few periods and types."""
    rng = random.Random(17)
    names = [(i, f"c{i}", f"p{rng.randrange(6)}", f"n{rng.randrange(9)}") for i in range(400)]
    works = [(i, rng.randrange(400), f"t{i}", rng.choice(["Sonata", "Mass", "Trio", "Suite", None]), rng.choice(["Op. 1", "BWV 2", None]),
              rng.choice(["C major", "A minor", None])) for i in range(900)]
    w = spark.createDataFrame(works, "work_id int, composer_id int, title string, work_type string, catalog_number string, key string")
    c = spark.createDataFrame(names, "composer_id int, name string, period string, country string")
    g = spark.createDataFrame([(i, rng.choice(["dark", "solo", "calm"]), "m") for i in range(900) if i % 3], "work_id int, tag string, source string")
    return cut(feature_rows(w, c, tag_tfidf(w, g)[0]))


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan", "dot"])
def test_small_composers_are_settled_inside_wider_classes(spark, small_composers, metric, monkeypatch):
    """Lists that one composer cannot fill are settled by period and type: exact, and with a part of all pairs."""
    _members, distinct = similarity.profiles(small_composers, 6)
    distinct = cut(distinct.drop("ids"))
    full = blocks.top_items(distinct, distinct, 6, similarity.content_block(Weights(), metric), "profile_id", "profile_id")
    full = sorted(map(tuple, full.collect()))
    pairs, top_within = [], similarity.top_within

    def counted(items, keys, *args, queries=None, **kw):
        q = (items if queries is None else queries).groupBy(*keys).agg(F.count("*").alias("a"))
        pairs.append(q.join(items.groupBy(*keys).agg(F.count("*").alias("b")), keys).agg(F.sum(F.col("a") * F.col("b"))).first()[0])
        return top_within(items, keys, *args, queries=queries, **kw)

    monkeypatch.setattr(similarity, "top_within", counted)
    monkeypatch.setattr(similarity, "top_items", lambda open_, *a, **k: pairs.append(open_.count() * distinct.count()) or blocks.top_items(open_, *a, **k))
    fast = similarity.near_profiles(distinct, 6, metric, Weights())
    assert sorted(map(tuple, fast.select("profile_id", "item_id", "score", "rank").collect())) == full
    if metric in ("cosine", "dot"):
        assert sum(pairs) < 0.25 * distinct.count() ** 2


def test_bounds_hold():
    """The best score of works that share no tested class, against all ways to share columns."""
    w, rest = Weights(), 9.25
    known = [similarity.class_bound(similarity.CLASSES[:i], "cosine", w, rest) for i in range(6)]
    assert [round(x, 4) for x in known] == [1.0, 0.5968, 0.4315, 0.25, 0.1855, 0.1492]
    assert similarity.class_bound(similarity.CLASSES, "dot", w, rest) == rest
    assert [similarity.class_bound((), m, w, rest) for m in ("euclidean", "manhattan")] == [1.0, 1.0]


def test_embedding_quality_with_zero_vectors(spark):
    from ostinato.operators import semantic

    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    r = semantic.embedding_quality(df).first()
    assert (r["num_works"], r["min"], r["max"]) == (4, 0.0, 1.0)
    assert abs(r["mean"] - 1 / 6) < 1e-9 and abs(r["std"] - (1 / 6 - 1 / 36) ** 0.5) < 1e-9


def test_diverse_for_many_seeds(spark):
    """More seeds and items than one block: seeds and picks stay in frames."""
    import numpy as np

    rng = np.random.default_rng(4)
    m = rng.normal(size=(900, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    rows = rerank.diverse(df, df.select("id"), 2, 0.5, blocks.cosine_block("v"), "id", seed_rows=250, block_rows=300).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    first = np.round(0.5 * s, 6).argmax(axis=1)
    assert len(rows) == 1800
    assert all(r.item_id == first[r.seed_id] for r in rows if r["rank"] == 1)
    for r in rows[:200]:
        if r["rank"] == 2:
            value = np.round(0.5 * s[r.seed_id] - 0.5 * (u @ u[first[r.seed_id]]), 6)
            value[[r.seed_id, first[r.seed_id]]] = -9
            assert r.item_id == value.argmax()


def test_draws_are_uniform_and_runs_repeat(spark):
    """Draws spread over (0, 1); each run of a search equals the single draw of its seed, and runs differ."""
    n = 20_000
    r = spark.range(n).select(rerank.uniform("id", seed=1).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u"), F.avg(F.col("u") * F.col("u")), F.count_distinct("u")).first()
    assert 0 < r[0] and r[1] < 1 and abs(r[2] - 0.5) < 0.01 and abs(r[3] - 1 / 3) < 0.01 and r[4] == n
    valid = spark.range(60).select((F.col("id") % 2).alias("q"), "id", (0.9 - F.col("id") / 100).alias("score"))
    runs = rerank.sampled_runs(valid, 5, "q", "id", runs=4, seed=9).collect()
    picked = {run: {r.id for r in runs if r.run == run} for run in range(1, 5)}
    for run, ids in picked.items():
        assert ids == {r.id for r in rerank.sample_by_score(valid, 5, "q", "id", seed=8 + run).collect()} and len(ids) == 10
    assert len({frozenset(x) for x in picked.values()}) > 1
    assert all(r.id < 30 for r in runs)  # the pool is three times the sample


def test_pairs_with_features_are_not_sorted(spark):
    """The join by the second work hashes the features; only narrow pairs are sorted or exchanged twice."""
    one = spark.range(50).selectExpr("id AS work_id", "'n' AS name", "'p' AS period", "'c' AS country", "'t' AS work_type", "'k' AS key", "1 AS key_pos", "array(0) AS terms",
                                     "array(1D) AS weights", "1 AS flags", "2D AS norm2")
    pairs = spark.range(200).selectExpr("id % 50 AS src", "id * 7 % 60 AS dst")
    scored = similarity.score_pairs(pairs, one, ["cosine"])
    plan = scored._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan.splitlines()[1] + plan.splitlines()[0] + plan.splitlines()[2]
    assert scored.count() == pairs.where("dst < 50").count()


def test_bought_pairs_are_joined_once_for_both_directions(spark, monkeypatch, tmp_path):
    """Half the pairs are dealt and joined with features; the reverse is scored from the same row, also by a metric that is not symmetric."""
    from ostinato.plans.queries_similarity import bought_pairs
    from ostinato.plans.views import Tables

    lines = [(1, 3), (1, 5), (1, 3), (2, 5), (2, 3), (2, 9), (None, 3), (None, 5), (4, None), (4, 9), (6, 77), (6, 9)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    pairs = bought_pairs(Tables(spark, str(tmp_path)))
    assert sorted(map(tuple, pairs.collect())) == [(3, 5), (3, 9), (5, 9), (9, 77)]
    rows = spark.createDataFrame([(3, "a"), (5, None), (9, "ccc"), (9, "dd")], "work_id long, name string").selectExpr(
        "*", "'p' AS period", "'c' AS country", "'t' AS work_type", "'k' AS key", "1 AS key_pos", "array(0) AS terms", "array(1D) AS weights", "1 AS flags", "2D AS norm2")
    monkeypatch.setitem(similarity.METRICS, "longer", lambda a, b, _w: F.length(a("name")) - F.length(b("name")) * 2.0)
    got = similarity.score_pairs(pairs, rows, ["longer", "cosine"], both_ways=True)
    reverse = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    plain = similarity.score_pairs(pairs.unionByName(reverse), rows, ["longer", "cosine"])
    assert got.columns == plain.columns
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert order(got) == order(plain) and got.count() == 10


def test_histogram_sends_rows_a_bounded_number_of_times(spark, monkeypatch):
    """Blocks grow with the table: the tasks, and with them the copies of each row and the partial counts, do not."""
    from ostinato.operators import semantic

    monkeypatch.setattr(semantic, "LEAST_ROWS", 4)
    made, real = [], semantic.numbered_blocks
    monkeypatch.setattr(semantic, "numbered_blocks", lambda *a: made.append(real(*a)[1]) or real(*a))
    df = spark.range(320).selectExpr("id AS vec_id", "array(cast(sin(id) AS float), cast(cos(id * 3) AS float)) AS embedding")
    small = semantic.pair_histogram(df.where("vec_id < 64"))
    assert small.agg(F.sum("n")).first()[0] == 64 * 63 // 2
    whole = semantic.pair_histogram(df)
    assert made == [16, 16] and whole.agg(F.sum("n")).first()[0] == 320 * 319 // 2


def test_dense_unit_vectors(spark):
    cells = {1: {}, 2: {0: 3.0, 4: -4.0}, 3: {2: 0.0}, 4: {i: float(i + 1) for i in range(5)}, 5: {3: 2.0}}
    df = spark.createDataFrame([(k, sorted(c.items())) for k, c in cells.items()], "id int, m array<struct<i: int, x: double>>")
    for r in df.select("id", semantic.dense_unit(F.col("m"), 5).alias("v")).collect():
        raw = [cells[r["id"]].get(i, 0.0) for i in range(5)]
        assert r["v"] == pytest.approx([x / (math.sqrt(sum(y * y for y in raw)) or 1.0) for x in raw], abs=1e-7)


def test_hashed_vectors_sum_their_length_once_a_text(spark):
    words = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(1, "one two two"), (2, None), (3, ""), (4, words)], "id int, text string")
    e = semantic.embed(df, "id", "text", dim=384)
    got = {r["id"]: r["embedding"] for r in e.collect()}
    assert sorted(got) == [1, 2, 3, 4] and all(len(v) == 384 for v in got.values()) and not any(got[2]) and not any(got[3])
    assert [round(sum(x * x for x in got[i]), 5) for i in (1, 4)] == [1.0, 1.0] and sum(x != 0 for x in got[1]) == 2
    plan = e._jdf.queryExecution().optimizedPlan().toString()  # a sum inside the lambda over places would run once a place
    assert plan.count("aggregate(") == 1, plan
