import json

import pytest
from pyspark.sql import functions as F

from ostinato.operators import catalog, conform, quality
from ostinato.plans.etl import run_etl
from ostinato.sources import documents, schemas, sinks, tables

WORKS = "work_id string, composer_id string, title string, work_type string, key string, catalog_number string"


@pytest.fixture
def works(spark):
    return spark.createDataFrame([
        ("work1", "bach", " Symphony No. 1", "Symphony ", "C major", "Op. 1"), ("work1b", "bach", " Symphony No. 1", "Symphony ", "C major", "Op. 1"),
        ("work2", "mozart", "Symphony No. 2", "Symphony", "D major", "Op. 2"), ("work3", None, "Concerto in D", "Concerto", "D major", "K. 123")], WORKS)


@pytest.fixture
def composers(spark):
    return spark.createDataFrame([("bach", "Johann Sebastian Bach", "Baroque"), ("mozart", "Wolfgang Amadeus Mozart", "Classical")], "composer_id string, name string, period string")


@pytest.fixture
def tags(spark):
    return spark.createDataFrame([("work1", " Baroque", "m"), ("work1", "symphony", "m"), ("work2", "classical", "a"), ("work3", "concerto", "a"), ("nonexistent_work", "x", "m")],
                                 "work_id string, tag string, source string")


def test_clean(works, composers, tags):
    w, c, g = conform.clean(works, composers, tags)
    assert sorted(r.work_id for r in w.collect()) == ["work1", "work2", "work3"]
    assert {r.work_id: r.composer_id for r in w.collect()}["work3"] == conform.UNKNOWN_COMPOSER
    assert {r.name for r in c.collect()} == {"Johann Sebastian Bach", "Wolfgang Amadeus Mozart", "Unknown"}
    assert sorted(r.tag for r in g.collect()) == ["baroque", "classical", "concerto", "symphony"]
    assert {r.work_type for r in w.collect()} == {"symphony", "concerto"}
    row = quality.load_report(w, c, g).first()
    assert (row.total_works, row.total_composers, row.total_tags, row.unique_tags) == (3, 3, 4, 4)
    assert row.orphaned_tags == 0 and row.works_with_no_tags == 0 and row.median_tags_per_work == 1.0
    with pytest.raises(ValueError):
        conform.handle_missing_composers(works, composers, "other")


def test_link_inference(spark, composers):
    w = spark.createDataFrame([("a", None, "Variations on a theme of Bach"), ("b", None, "mozart, wolfgang amadeus: arias"), ("c", None, "Suite, BWV 9"), ("d", None, "Suite"), ("e", "z", "Bach"), ("f", None, None)],
                              "work_id string, composer_id string, title string")
    got = {r.work_id: r.composer_id for r in conform.infer_composer_links(w, composers, {"bwv": "cat"}).collect()}
    assert got == {"a": "bach", "b": "mozart", "c": "cat", "d": None, "e": "z", "f": None}


def test_alias_rules(spark):
    c = spark.createDataFrame([("1", "Anna Bach"), ("2", "Carl Bach"), ("3", "anna bach"), ("4", "Solo")], "composer_id string, name string")
    got = {r.alias: r.composer_id for r in conform.composer_aliases(c).collect()}
    assert got["bach"] == "1"  # a last name belongs to the first
    assert got["anna bach"] == "3"  # a full name to the last
    assert got["bach, carl"] == "2" and got["solo"] == "4"


def test_search_and_filters(works, composers):
    assert [r.work_id for r in catalog.search_titles(works, "SYMPHONY", 2).collect()] == ["work1", "work1b"]
    assert catalog.search_titles(works, "C++ (").count() == 0
    assert [r.work_id for r in catalog.filter_works(works, composers, period="Classical", key="D major").collect()] == ["work2"]
    with pytest.raises(ValueError, match="Composer not found"):
        catalog.browse(works, composers, composer="nobody")
    with pytest.raises(ValueError, match="No works match"):
        catalog.browse(works, composers, composer="bach", key="F major")


def test_title_repair(spark):
    u = "0a1b2c3d-0000-4000-8000-00000000000"
    w = spark.createDataFrame([("1", "c", "Aria", "Song", "C major", "K. 1"), ("2", "c", u + "2", "Song", "C major", "K. 1"), ("3", "c", u + "3", "Mass", None, "K. 2"),
                               ("4", "c", u + "4", "Mass", "D minor", None), ("5", "c", u + "5", None, None, None), ("6", "c", u + "6", None, None, "K. 9")], WORKS)
    got = {r.work_id: r.title for r in quality.repair_titles(w).collect()}
    assert got == {"1": "Aria", "2": "Aria (alternate)", "3": "Mass K. 2", "4": "Mass in D minor", "5": "Unknown Work (None)", "6": "Unknown Work (K. 9)"}


def test_scans(spark, works, tmp_path):
    works.write.parquet(str(tmp_path / "w.parquet"))
    got = tables.scan_works(spark, str(tmp_path / "w.parquet"))
    assert got.columns[:7] == schemas.WORKS.fieldNames() and got.count() == 4
    with pytest.raises(FileNotFoundError):
        tables.scan_tags(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(ValueError, match="missing required columns"):
        tables.scan_composers(spark, str(tmp_path / "w.parquet"))
    assert tables.scan_csv(spark, str(tmp_path / "none.csv"), schemas.PLAIN_TAGS, missing_ok=True).count() == 0
    (tmp_path / "names.txt").write_text(" Bach \n\n  \nMozart\n")
    assert [r.name for r in tables.scan_names(spark, str(tmp_path / "names.txt")).collect()] == ["Bach", "Mozart"]
    (tmp_path / "log.jsonl").write_text('{"work_id": "1", "removed": ["a"]}\n\n{"work_id": "2"}\n')
    assert [(r.work_id, r.removed, r.added) for r in tables.scan_corrections(spark, str(tmp_path / "log.jsonl")).collect()] == [("1", ["a"], []), ("2", [], [])]


def test_sinks(spark, works, tmp_path):
    out = str(tmp_path)
    sinks.write_tables({"works": works, "none": works.limit(0)}, out)
    assert spark.read.parquet(f"{out}/none.parquet").columns == works.columns
    res = sinks.parquet_folder_to_csv(spark, ["works", "gone"], out, f"{out}/csv")
    assert res["works"] == "ok" and res["gone"] != "ok"
    with pytest.raises(ValueError, match="unsupported format"):
        sinks.export_tags(works, f"{out}/x", "xml")
    back = sinks.repair_table(spark, f"{out}/works.parquet", quality.repair_titles(spark.read.parquet(f"{out}/works.parquet")))
    assert spark.read.parquet(back).count() == spark.read.parquet(f"{out}/works.parquet").count() == 4


def artist(name, works, **more):
    return {"artist": {"artist_id": f"id-{name}", "name": name, "life_span": {"begin": "1685-03-21", "end": "1750"}, "tags": ["baroque"], **more}, "works": works,
            "extraction_timestamp": "2024"}


def test_etl_job(spark, tmp_path):
    src = tmp_path / "raw"
    src.mkdir()
    (src / "Bach_combined.json").write_text(json.dumps(artist("Bach", [
        {"release_group_id": "w1", "title": "Mass in B minor, BWV 232", "tags": ["sacred", "sacred"], "source": "musicbrainz"},
        {"musicbrainz_id": "w2", "title": "Suite"}, {"title": "no id"}], annotation={"text": "hello"}), indent=1))
    (src / "Liszt_musicbrainz.json").write_text(json.dumps(artist("Liszt", [], annotation="plain", musicbrainz_tags=["piano"])))
    (src / "notes.json").write_text("{}")
    r = run_etl(spark, str(src), str(tmp_path / "out"))
    comp = {x.name: x for x in r.tables["composers"].collect()}
    assert comp["Bach"].annotation == "hello" and comp["Liszt"].annotation == "plain" and comp["Liszt"].mb_tags == ["piano"]
    assert comp["Bach"].period == "Baroque" and comp["Bach"].total_works_count == 2 and comp["Liszt"].total_works_count == 0
    w = {x.work_id: x for x in r.tables["works"].collect()}
    assert (w["w1"].catalog_number, w["w1"].work_type, w["w1"].key) == ("BWV 232", "Mass", "B minor") and w["w2"].mb_tags == []
    assert [tuple(x) for x in r.tables["work_tags"].collect()] == [("w1", "sacred", "musicbrainz")]
    assert r.status == 0
    only = documents.scan_documents(spark, str(src), ["Liszt"])
    assert [x.name for x in only.select("artist.name").collect()] == ["Liszt"]


def test_profiles(spark):
    ok = {"artist": {"name": "A"}, "works": None, "metadata": {"extraction_timestamp": "x"}}
    rows = [ok, {**ok, "artist": {}}, {**ok, "works": [{"title": None}]}, {"artist": {"name": "B"}}]
    raw = spark.createDataFrame([(json.dumps(r),) for r in rows] + [("not json",)], "value string")
    valid, bad = documents.validate_profiles(raw)
    assert [r.works for r in valid.collect()] == [[]]
    assert sorted(r.reason for r in bad.collect()) == ["artist.name is missing", "metadata.extraction_timestamp is missing", "not a profile", "works.title is missing"]


def test_flatten_raw(spark):
    raw = spark.createDataFrame([(json.dumps({"id": "a", "name": "N", "sort-name": "S", "tag-list": [{"name": "x", "count": 2}], "life-span": {"begin": "1900"}}),)], "value string")
    r = documents.flatten_artists(raw).first()
    assert (r.artist_id, r.sort_name, r.tags, r.annotation, r.life_span.begin) == ("a", "S", ["x"], "", "1900")
    listing = spark.createDataFrame([("1", '{"id":"1","title":"T","type":"Album"}'), ("2", '{"id":"2","title":"U"}')], "id string, value string")
    details = spark.createDataFrame([("1", '{"id":"1","title":"T2","tag-list":[{"name":"y"}],"secondary-type-list":["Live"]}')], "id string, value string")
    got = {x.release_group_id: x for x in documents.flatten_releases(listing, details).collect()}
    assert got["1"].title == "T2" and got["1"].tags == ["y"] and got["1"].secondary_types == ["Live"] and got["2"].title == "U" and got["2"].tags == []


def test_issue_finder(spark):
    w = spark.createDataFrame([("1", "0A1b2c3d-0000-4000-8000-000000000001"), ("2", ""), ("3", None), ("4", "untitled piece"), ("5", "Fine"), ("6", "Fine")], "work_id string, title string")
    assert sorted((r.type, r.work_id) for r in quality.find_issues(w).collect()) == [("generic_title", "4"), ("missing_title", "2"), ("missing_title", "3"), ("uuid_title", "1")]
    assert {r.type: r.n for r in quality.issue_counts(w).collect()}["duplicate_titles"] == 1
    assert F is not None


def test_csv_line_breaks_only_when_asked(spark, tmp_path):
    (tmp_path / "t.csv").write_text('work_id,tag,source\n1,"a\nb",x\n2,c,y\n')
    path = str(tmp_path / "t.csv")
    assert {r.tag for r in tables.scan_csv(spark, path, schemas.PLAIN_TAGS, multi_line=True).collect()} == {"a\nb", "c"}
    assert tables.scan_csv(spark, path, schemas.PLAIN_TAGS).count() == 3


def test_aliases_meet_titles_by_their_rarest_gram(spark):
    """Every substring search by brute force; a title makes about one row a character before the join."""
    import random

    from ostinato.operators import conform

    rng = random.Random(6)
    names = ["Bo", "J", "Ann Lee", "Anna Leeds", "Johann Bach", "Bach", "Li Bo", "Symphony Man", "ymph", "Özgür Ünal", "a.b c%d", "Lee, Ann"] + [f"Name {i:03d}" for i in range(40)]
    composers = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "composer_id int, name string")
    titles = [None, "", "J", "Bo", "ann", "LEE, ANN", "özgür ünal!"] + ["".join(rng.choice(["Bach", "Symphony ", "Name 0", "17", "Ann", " Lee", "x", "bo", "J", "a.b c%d"]) for _ in range(rng.randrange(1, 7))) for _ in range(120)]
    works = spark.createDataFrame([(i, None, t) for i, t in enumerate(titles)] + [(999, 5, "Name 001")], "work_id int, composer_id int, title string")
    aliases = sorted((r.ord, r.alias, r.composer_id) for r in conform.composer_aliases(composers).collect() if r.alias)
    got = {r.work_id: r.composer_id for r in conform.infer_composer_links(works, composers, {}).collect()}
    for i, t in enumerate(titles):
        hits = [c for _, a, c in aliases if t is not None and a in t.lower()]
        assert got[i] == (hits[0] if hits else None), t
    assert got[999] == 5
    long_titles = works.filter("title IS NOT NULL").withColumn("title", F.rpad("title", 43, "abcdefgh ijk"))
    assert conform.title_grams(long_titles, []).groupBy("work_id").count().agg(F.max("count")).first()[0] <= 40
    index = conform.alias_index(conform.composer_aliases(composers).filter("alias <> ''"))
    assert index.count() == len(aliases)


def test_numbering_of_a_hot_key(spark):
    """A key with nine tenths of the rows spans several tasks and is numbered without gaps; nulls are a key."""
    from ostinato.operators import shape

    df = spark.range(20000).select((F.col("id") * 7919 % 20011).alias("v"), F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 70)).alias("k"), F.lit("x").alias("other"))
    got = shape.numbered(df, ["k"], [F.desc("v")], "place")
    assert got.columns == ["v", "k", "other", "place"]
    rows = {}
    for r in got.collect():
        rows.setdefault(r.k, []).append((r.place, -r.v))
    assert len(rows["hot"]) == 18000 and len(rows[None]) == 1000
    for found in rows.values():
        found.sort()
        assert [p for p, _ in found] == list(range(1, len(found) + 1)) and [v for _, v in found] == sorted(v for _, v in found)
    totals = shape.running_total(df.filter("k = 'hot'"), ["k"], [F.col("v")], F.col("v"), "s").orderBy("v").collect()
    run = 0
    for r in totals:
        run += r.v
        assert r.s == run
