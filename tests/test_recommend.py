import pytest
from pyspark.sql import functions as F

from ostinato.operators import catalog, recommend
from ostinato.operators.features import feature_rows, tag_tfidf
from ostinato.sources import catalogue

WORKS = [(i, i % 4 or None, f"Sonata No. {i} in C major" if i % 2 else f"Mass {i}", "Sonata" if i % 2 else "Mass", "C major" if i % 3 else None, f"Op. {i}") for i in range(1, 41)]


@pytest.fixture(scope="module")
def tables(spark):
    w = spark.createDataFrame(WORKS, "work_id int, composer_id int, title string, work_type string, key string, catalog_number string")
    c = spark.createDataFrame([(1, "A B", "Baroque", "DE"), (2, "C D", "Romantic", "FR"), (3, "E F", "Baroque", None)], "composer_id int, name string, period string, country string")
    g = spark.createDataFrame([(i, t, "m") for i in range(1, 41) for t in ("calm", "dark", "bright", "slow", "grand", "tender")[: i % 7]], "work_id int, tag string, source string")
    return w, c, g


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    w, c, g = tables
    base = tmp_path_factory.mktemp("store")
    for name, df in zip("wcg", tables):
        df.write.parquet(f"{base}/{name}")
    src = [spark.read.parquet(f"{base}/{n}") for n in "wcg"]
    made = []

    def build(name, fn):
        return catalogue.kept(spark, f"{base}/kept-{name}", "1", src, lambda: made.append(name) or fn(), "work_id")

    cards = build("cards", lambda: recommend.cards(w, c, g))
    features = build("features", lambda: feature_rows(w, c, tag_tfidf(w, g)[0]))
    return cards, features, build, made, base


def test_full_rows(stored):
    cards, features, *_ = stored
    got = recommend.similar(features, cards, 5, 6).orderBy("rank").collect()
    assert got[0].asDict().keys() == dict.fromkeys(recommend.ROW).keys()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5, 6] and all(r.work_id != 5 for r in got)
    assert all(a.similarity_score >= b.similarity_score for a, b in zip(got, got[1:]))
    one = got[0]
    assert one.composer == "A B" and one.explanation == "Like your selection, this is a Baroque Sonata in C major by the same composer"
    assert all(r.tags is None or 1 <= len(r.tags) <= 5 for r in got)
    with pytest.raises(ValueError, match="Work ID not found"):
        recommend.similar(features, cards, 999)
    by_title = recommend.similar_to_title(features, cards, "no. 5 in", 6).orderBy("rank").collect()
    assert by_title == got
    with pytest.raises(ValueError, match="No works found"):
        recommend.similar_to_title(features, cards, "zzz")


def test_diverse_and_browse_rows(stored, tables):
    cards, features, *_ = stored
    got = recommend.diverse(features, cards, [5, 6], 4).collect()
    assert {(r.seed_id, r["rank"]) for r in got} == {(s, k) for s in (5, 6) for k in (1, 2, 3, 4)} and all(r.explanation for r in got)
    w, c, _ = tables
    rows = recommend.browse(w, c, cards, composer="a b", n=3).orderBy("rank").collect()
    assert [r.work_id for r in rows] == [1, 5, 9] and all(r.similarity_score == 1.0 and r.explanation is None for r in rows)


def test_a_lookup_reads_stored_columns_by_id(stored):
    """The plan of a lookup has the id as pushed filter, reads the wanted columns only, and parses no title."""
    cards, *_ = stored
    plan = catalog.work_by_id(cards, 7).select("work_id", "title")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(work_id), EqualTo(work_id,7)]" in plan and "ReadSchema: struct<work_id:int,title:string>" in plan
    assert "regexp" not in plan.lower() and "rlike" not in plan.lower()


def test_kept_until_the_files_change(stored, spark, tables):
    cards, _, build, made, base = stored
    assert sorted(made) == ["cards", "features"]
    assert build("cards", lambda: None).count() == 40 and sorted(made) == ["cards", "features"]
    ids = [r.work_id for f in sorted(set(cards.inputFiles())) for r in spark.read.parquet(f).select("work_id").collect()]
    assert ids == sorted(ids)
    tables[0].filter("work_id < 3").write.mode("append").parquet(f"{base}/w")
    src = [spark.read.parquet(f"{base}/{n}") for n in "wcg"]
    again = catalogue.kept(spark, f"{base}/kept-cards", "1", src, lambda: made.append("again") or recommend.cards(*tables), "work_id")
    assert made[-1] == "again" and again.count() == 40


def test_mood_search_is_one_job(stored, tables, spark):
    cards, *_ = stored
    descriptions = tables[0].select("work_id", F.concat_ws(" ", "title", F.when(F.col("work_id") % 2 == 0, "calm peaceful gentle").otherwise("dramatic dark tragic")).alias("description"))
    q = spark.createDataFrame([("peaceful and calm",), ("dark and dramatic",), ("zzz qqq",)], "query string")
    rows = recommend.mood_search(q, descriptions, cards, 5).collect()
    assert {r.query for r in rows} == {"peaceful and calm", "dark and dramatic"}
    assert all((r.work_id % 2 == 0) == (r.query == "peaceful and calm") for r in rows) and all(r.explanation for r in rows)
    assert rows == recommend.mood_search(q, descriptions, cards, 5).collect()
    best = recommend.mood_search(q, descriptions, cards, 5, multiplier=None).collect()
    assert len(best) == len(rows) and min(r.similarity_score for r in best) >= 0.15


def test_works_are_spread_before_the_parse(spark, monkeypatch):
    """One file of many works is many tasks, in ranges of the key; a key with most rows is not one task."""
    monkeypatch.setattr(catalogue, "ROWS_A_TASK", 100)
    df = spark.range(1000).selectExpr("id AS work_id", "concat('Sonata in C, Op. ', id) AS title").coalesce(1)
    parts = catalogue.spread(df, "work_id").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.min("work_id").alias("a"), F.max("work_id").alias("b")).orderBy("a").collect()
    assert len(parts) > 5 and sum(r.n for r in parts) == 1000 and all(x.b < y.a for x, y in zip(parts, parts[1:]))
    nulls = df.withColumn("work_id", F.lit(None).cast("bigint"))
    assert catalogue.spread(nulls, "work_id").select(F.spark_partition_id()).distinct().count() > 5


def test_kept_works_are_parsed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def mark(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    spark.range(500).withColumnRenamed("id", "work_id").write.parquet(str(tmp_path / "src"))
    src = spark.read.parquet(str(tmp_path / "src"))
    got = catalogue.kept(spark, str(tmp_path / "kept"), "1", [src], lambda: catalogue.spread(src, "work_id").mapInArrow(mark, "work_id bigint"), "work_id", ranged=True)
    assert got.count() == 500 and seen.value == 500
