"""Queries: scans, sinks, conforming, quality (S, P, J1, J5, J6, J10, J11, F1-F5, A1-A5, W2, W6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.functions.titles import all_catalog_numbers, all_work_types, enrich_titles, period_of, work_type, year_of
from ostinato.operators import catalog, conform, corrections, quality
from ostinato.plans.common import CORRECTIONS_SQL, OLD_NEW_SQL, derived_corrections
from ostinato.plans.registry import query
from ostinato.plans.views import Tables, _re2, all_rules
from ostinato.sources import documents, schemas, sinks, tables
from ostinato.session import fresh_path

STR = "string"


def _stored(t: Tables, **frames):
    folder = fresh_path(t.spark, "tables")
    sinks.write_tables(frames, folder)
    return folder


# --- S: scans and sinks ----------------------------------------------------------------------------

@query("s1_scan_works", "works", "SELECT CAST(work_id AS VARCHAR) AS work_id, title, work_type, key, catalog_number FROM works")
def _(t: Tables):
    folder = _stored(t, works=t.works)
    return tables.scan_works(t.spark, f"{folder}/works.parquet").select("work_id", "title", "work_type", "key", "catalog_number")


@query("s2_scan_composers", "composers",
       "SELECT CAST(composer_id AS VARCHAR) AS composer_id, name, period, birth_year FROM composers")
def _(t: Tables):
    folder = _stored(t, composers=t.composers)
    return tables.scan_composers(t.spark, f"{folder}/composers.parquet").select("composer_id", "name", "period", "birth_year")


@query("s3_scan_tags", "tags", "SELECT CAST(work_id AS VARCHAR) AS work_id, tag, source, confidence FROM tags")
def _(t: Tables):
    folder = _stored(t, tags=t.tags)
    return tables.scan_tags(t.spark, f"{folder}/tags.parquet").select("work_id", "tag", "source", "confidence")


def artist_documents(t: Tables):
    """Artist documents, one per composer and work type, so that no document is large."""
    w = t.works.filter("composer_id IS NOT NULL").groupBy("composer_id", "work_type", "key").agg(F.collect_list(F.struct(
        F.lit("musicbrainz").alias("source"), F.col("work_id").cast(STR).alias("release_group_id"), "title",
        F.array_compact(F.array("work_type", "key")).alias("tags"))).alias("works"))
    j = t.composers.join(w, "composer_id")
    return j.select(
        F.struct(
            F.lit("musicbrainz").alias("source"), F.col("composer_id").cast(STR).alias("artist_id"), "name", "country",
            F.struct(F.col("birth_year").cast(STR).alias("begin"), F.col("death_year").cast(STR).alias("end")).alias("life_span"),
            F.array(F.lit("composer")).alias("tags"),
            F.concat(F.lit('{"text": "'), F.col("name"), F.lit('"}')).alias("annotation")).alias("artist"),
        "works", F.lit("2024-01-01T00:00:00").alias("extraction_timestamp"))


@query("s4_scan_documents", "works composers", """SELECT name, CAST(count(*) AS BIGINT) AS works, CAST(count(DISTINCT title) AS BIGINT) AS titles
FROM works JOIN composers USING (composer_id) GROUP BY name""")
def _(t: Tables):
    path = fresh_path(t.spark, "documents")
    artist_documents(t).write.json(path)
    docs = documents.scan_documents(t.spark, path, pattern="*.json", multi_line=False)
    return docs.select("artist.name", F.explode("works").alias("w")).groupBy("name").agg(
        F.count("*").alias("works"), F.count_distinct("w.title").alias("titles"))


@query("s5_flatten_documents", "works", """SELECT CAST(work_id AS VARCHAR) AS release_group_id,
 title, work_type AS primary_type, CASE WHEN catalog_number IS NOT NULL THEN concat_ws('|', work_type, key) ELSE '' END AS tags,
 catalog_number IS NOT NULL AS has_detail FROM works""")
def _(t: Tables):
    def record(*extra):
        return F.to_json(F.struct(F.col("work_id").cast(STR).alias("id"), "title", F.col("work_type").alias("type"), *extra))

    tag_list = F.transform(F.array_compact(F.array("work_type", "key")), lambda x: F.struct(x.alias("name"))).alias("tag-list")
    listing = t.works.select(F.col("work_id").alias("id"), record().alias("value"))
    details = t.works.filter("catalog_number IS NOT NULL").select(F.col("work_id").alias("id"), record(tag_list).alias("value"))
    out = documents.flatten_releases(listing, details)
    return out.select("release_group_id", "title", "primary_type", F.array_join("tags", "|").alias("tags"), "has_detail")


@query("s6_validate_profiles", "dirty_works composers", """SELECT CASE WHEN name IS NULL THEN 'artist.name is missing'
 WHEN title IS NULL THEN 'works.title is missing' ELSE 'valid' END AS reason, CAST(count(*) AS BIGINT) AS n
 FROM dirty_works LEFT JOIN composers USING (composer_id) GROUP BY 1""")
def _(t: Tables):
    j = t.dirty_works.join(t.composers.select("composer_id", "name"), "composer_id", "left")
    raw = j.select(F.to_json(F.struct(
        F.struct("name").alias("artist"), F.array(F.struct("title")).alias("works"),
        F.struct(F.lit("2024-01-01").alias("extraction_timestamp")).alias("metadata"))).alias("value"))
    valid, rejected = documents.validate_profiles(raw)
    ok = valid.select(F.lit("valid").alias("reason"))
    return ok.unionByName(rejected.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("s7_scan_csv", "tags", "SELECT CAST(work_id AS VARCHAR) AS work_id, tag, source, confidence FROM tags")
def _(t: Tables):
    path = fresh_path(t.spark, "csv")
    sinks.write_csv(t.tags, path)
    return tables.scan_csv(t.spark, path, schemas.TAGS).select("work_id", "tag", "source", "confidence")


@query("s8_scan_names", "", "SELECT s_name AS name FROM supplier WHERE s_nationkey <> 3")
def _(t: Tables):
    path = fresh_path(t.spark, "names")
    line = F.when(F.col("s_nationkey") == 3, F.lit("   ")).otherwise(F.concat(F.lit("  "), F.col("s_name"), F.lit(" ")))
    t.base("supplier").select(line.alias("value")).write.text(path)
    return tables.scan_names(t.spark, path)


CORRECTION_ROW = """SELECT CAST(work_id AS VARCHAR) AS work_id, work_type, array_to_string(removed, '|') AS removed,
 array_to_string(added, '|') AS added, reviewer, "timestamp" FROM corrections"""


@query("s9_scan_corrections", "works tags", CORRECTION_ROW, OLD_NEW_SQL | CORRECTIONS_SQL)
def _(t: Tables):
    path = fresh_path(t.spark, "corrections")
    sinks.append_corrections(derived_corrections(t), path)
    return tables.scan_corrections(t.spark, path).select(
        "work_id", "work_type", F.array_join("removed", "|").alias("removed"), F.array_join("added", "|").alias("added"), "reviewer", "timestamp")


@query("s10_write_parquet", "works composers tags", """SELECT 'works' AS "table", CAST(count(*) AS BIGINT) AS n FROM works
 UNION ALL SELECT 'composers', count(*) FROM composers UNION ALL SELECT 'tags', count(*) FROM tags UNION ALL SELECT 'empty', 0""")
def _(t: Tables):
    folder = _stored(t, works=t.works, composers=t.composers, tags=t.tags, empty=t.spark.createDataFrame([], t.tags.schema))
    parts = [t.spark.read.parquet(f"{folder}/{n}.parquet").agg(F.count("*").alias("n")).select(F.lit(n).alias("table"), "n")
             for n in ("works", "composers", "tags", "empty")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("s11_parquet_to_csv", "works tags", """SELECT 'works' AS "table", 'ok' AS outcome, CAST(count(*) AS BIGINT) AS n FROM works
 UNION ALL SELECT 'tags', 'ok', count(*) FROM tags UNION ALL SELECT 'absent', 'failed', 0""")
def _(t: Tables):
    folder = _stored(t, works=t.works, tags=t.tags)
    out = fresh_path(t.spark, "csv-out")
    outcome = sinks.parquet_folder_to_csv(t.spark, ["works", "absent", "tags"], folder, out)
    parts = []
    for name, text in outcome.items():
        n = t.spark.read.option("header", True).csv(f"{out}/{name}.csv").agg(F.count("*").alias("n")) if text == "ok" else t.works.limit(0).agg(F.count("*").alias("n"))
        parts.append(n.select(F.lit(name).alias("table"), F.lit("ok" if text == "ok" else "failed").alias("outcome"), "n"))
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("s12_csv_to_parquet", "tags", """SELECT 'rows' AS measure, NULL AS source, CAST(count(*) AS BIGINT) AS n FROM tags
 UNION ALL SELECT 'works', NULL, count(DISTINCT work_id) FROM tags UNION ALL SELECT 'tags', NULL, count(DISTINCT tag) FROM tags
 UNION ALL SELECT 'source', source, count(*) FROM tags GROUP BY source""")
def _(t: Tables):
    path = fresh_path(t.spark, "tags-csv")
    sinks.write_csv(t.tags, path)
    return sinks.csv_to_parquet(tables.scan_csv(t.spark, path, schemas.TAGS), fresh_path(t.spark, "tags-parquet"))


@query("s13_export_tags", "tags", """SELECT CAST(count(*) AS BIGINT) AS associations, CAST(count(DISTINCT work_id) AS BIGINT) AS works,
 round(count(*) / count(DISTINCT work_id), 1) AS avg_tags_per_work FROM tags""")
def _(t: Tables):
    sinks.export_tags(t.tags, fresh_path(t.spark, "export"), "csv")
    return sinks.export_tags(t.tags, fresh_path(t.spark, "export"), "jsonl")


@query("s14_export_corrections", "works tags", """SELECT CAST(work_id AS VARCHAR) AS work_id, title, nullif(array_to_string(removed, ', '), '') AS removed_tags,
 nullif(array_to_string(added, ', '), '') AS added_tags FROM corrections""", OLD_NEW_SQL | CORRECTIONS_SQL)
def _(t: Tables):
    path = fresh_path(t.spark, "corrections-csv")
    sinks.export_corrections(derived_corrections(t), path)
    back = t.spark.read.option("header", True).csv(path)
    return back.select("work_id", "title", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("removed_tags", "added_tags")])


@query("s15_append_corrections", "works tags", "SELECT CAST(2 * count(*) AS BIGINT) AS n FROM corrections", OLD_NEW_SQL | CORRECTIONS_SQL)
def _(t: Tables):
    path = fresh_path(t.spark, "corrections")
    for _i in range(2):
        sinks.append_corrections(derived_corrections(t), path)
    return tables.scan_corrections(t.spark, path).agg(F.count("*").alias("n"))


@query("s16_quality_report", "works composers", """SELECT CAST((SELECT count(*) FROM works) AS BIGINT) AS total_works,
 CAST((SELECT count(*) FROM composers) AS BIGINT) AS total_composers, 'in' AS input_dir""")
def _(t: Tables):
    path = fresh_path(t.spark, "report")
    sinks.write_report(quality.profile_all(t.composers, t.works), path, "in", "out")
    r = t.spark.read.schema("input_dir string, metrics struct<total_works:bigint,total_composers:bigint>").json(path)
    return r.select("metrics.total_works", "metrics.total_composers", "input_dir")


@query("s17_embedding_artifact", "", "SELECT 'first' AS run, false AS reused, CAST(count(*) AS BIGINT) AS n FROM embeddings UNION ALL "
       "SELECT 'again', true, count(*) FROM embeddings UNION ALL SELECT 'new model', false, count(*) FROM embeddings")
def _(t: Tables):
    folder = fresh_path(t.spark, "artifact")
    parts = []
    for run, version in (("first", "m1"), ("again", "m1"), ("new model", "m2")):
        df, reused = sinks.load_or_build(t.spark, folder, version, t.embeddings, lambda d: d.select("vec_id", "embedding"))
        parts.append(df.agg(F.count("*").alias("n")).select(F.lit(run).alias("run"), F.lit(reused).alias("reused"), "n"))
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("s18_feature_artifact", "works", "SELECT 'first' AS run, false AS reused, CAST(count(*) AS BIGINT) AS n FROM works UNION ALL "
       "SELECT 'again', true, count(*) FROM works UNION ALL SELECT 'forced', false, count(*) FROM works")
def _(t: Tables):
    folder = fresh_path(t.spark, "features")
    parts = []
    for run, force in (("first", False), ("again", False), ("forced", True)):
        df, reused = sinks.load_or_build(t.spark, folder, "v1", t.works, lambda d: d.select("work_id", "work_type", "key"), force)
        parts.append(df.agg(F.count("*").alias("n")).select(F.lit(run).alias("run"), F.lit(reused).alias("reused"), "n"))
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("s19_repair_sink", "dirty_works", """SELECT 'backup' AS side, CAST(count(*) AS BIGINT) AS n,
 CAST(sum(CASE WHEN regexp_matches(title, '^[a-f0-9]{8}-') THEN 1 ELSE 0 END) AS BIGINT) AS uuid_titles FROM dirty_works
 UNION ALL SELECT 'table', count(*), 0 FROM dirty_works""")
def _(t: Tables):
    path = _stored(t, works=t.dirty_works) + "/works.parquet"
    backup = sinks.repair_table(t.spark, path, quality.repair_titles(t.spark.read.parquet(path)))

    def figures(side, p):
        return t.spark.read.parquet(p).agg(F.count("*").alias("n"), F.count_if(quality.is_uuid(F.col("title"))).alias("uuid_titles")).select(
            F.lit(side).alias("side"), "n", "uuid_titles")

    return figures("backup", backup).unionAll(figures("table", path))


@query("s20_profile_schema", "works", "SELECT CAST(count(*) AS BIGINT) AS titles FROM works WHERE composer_id IS NOT NULL AND composer_id IN (SELECT CAST(s_suppkey AS BIGINT) FROM supplier)")
def _(t: Tables):
    path, docs = fresh_path(t.spark, "schema"), fresh_path(t.spark, "documents")
    documents.export_schema(t.spark, path)
    artist_documents(t).write.json(docs)
    back = t.spark.read.schema(documents.load_schema(t.spark, path)).json(docs)
    return back.select(F.explode("works.title").alias("title")).agg(F.count("title").alias("titles"))


# --- P: conforming, J1 -------------------------------------------------------------------------------

def raw_artists(t: Tables):
    """Artist records with the id in either field, or in none."""
    even = F.col("composer_id") % 2 == 0
    text = F.col("composer_id").cast(STR)
    return t.composers.select(
        F.when(even, text).otherwise(F.lit("")).alias("musicbrainz_id"),
        F.when(F.col("country") == "NATION_7", None).otherwise(text).alias("artist_id"), "name", F.concat("name", F.lit(", the")).alias("sort_name"),
        F.struct(F.concat(F.col("birth_year").cast(STR), F.lit("-03-21")).alias("begin"), F.col("death_year").cast(STR).alias("end")).alias("life_span"),
        "country", F.concat(F.lit('{"text": "'), F.col("country"), F.lit('"}')).alias("annotation"), F.array("country").alias("musicbrainz_tags"))


def raw_release_groups(t: Tables):
    text = F.col("work_id").cast(STR)
    return t.raw_works.select(
        F.col("composer_id").cast(STR).alias("composer_id"), F.when(F.col("work_id") % 3 == 0, text).alias("musicbrainz_id"),
        text.alias("release_group_id"), "title",
        F.array(F.lower(F.split_part("title", F.lit(" "), F.lit(1))), F.lit("recorded"), F.lit("recorded")).alias("tags"),
        F.lit(None).cast(STR).alias("source"))


@query("p1_conform_composers", "works composers", """SELECT CAST(c.composer_id AS VARCHAR) AS composer_id, name, concat(name, ', the') AS sort_name,
 birth_year, death_year, country, period, country AS annotation, country AS mb_tags, CAST(coalesce(n, 0) AS BIGINT) AS total_works_count
 FROM composers c LEFT JOIN (SELECT composer_id, count(*) AS n FROM works GROUP BY 1) w ON c.composer_id = w.composer_id
 WHERE country IS DISTINCT FROM 'NATION_7' OR c.composer_id % 2 = 0""")
def _(t: Tables):
    works = conform.conform_works(raw_release_groups(t))
    return conform.conform_composers(raw_artists(t), works).withColumn("mb_tags", F.array_join("mb_tags", "|"))


@query("p2_conform_works", "works", """SELECT CAST(work_id AS VARCHAR) AS work_id, CAST(composer_id AS VARCHAR) AS composer_id, title, work_type,
 catalog_number, key FROM works""")
def _(t: Tables):
    return conform.conform_works(raw_release_groups(t)).drop("mb_tags")


@query("p3_conform_tags", "raw_works", """SELECT CAST(work_id AS VARCHAR) AS work_id, lower(split_part(title, ' ', 1)) AS tag, 'musicbrainz' AS source FROM raw_works
 UNION ALL SELECT CAST(work_id AS VARCHAR), 'recorded', 'musicbrainz' FROM raw_works""")
def _(t: Tables):
    return conform.conform_tags(raw_release_groups(t))


@query("p8_normalise", "dirty_works tags composers", """SELECT 'work' AS "table", trim(title) AS a, lower(trim(work_type)) AS b, trim(key) AS c FROM dirty_works
 UNION ALL SELECT 'tag', lower(trim(tag)), NULL, NULL FROM tags UNION ALL SELECT 'composer', trim(name), trim(period), NULL FROM composers""")
def _(t: Tables):
    w = conform.normalise_works(t.dirty_works).select(F.lit("work").alias("table"), F.col("title").alias("a"), F.col("work_type").alias("b"), F.col("key").alias("c"))
    none = F.lit(None).cast(STR)
    g = conform.normalise_tags(t.tags).select(F.lit("tag").alias("table"), F.col("tag").alias("a"), none.alias("b"), none.alias("c"))
    c = conform.normalise_composers(t.composers).select(F.lit("composer").alias("table"), F.col("name").alias("a"), F.col("period").alias("b"), none.alias("c"))
    return w.unionByName(g).unionByName(c)


@query("p9_fill_missing", "works composers", """SELECT work_id, coalesce(name, 'unknown') AS name, coalesce(period, 'unknown') AS period,
 coalesce(country, 'unknown') AS country, coalesce(work_type, 'unknown') AS work_type, coalesce(key, 'unknown') AS key, coalesce(catalog_number, '') AS catalog_number
 FROM works LEFT JOIN composers USING (composer_id)""")
def _(t: Tables):
    j = catalog.with_composers(t.works, t.composers, ["name", "period", "country"])
    return catalog.fill_for_features(j).select("work_id", "name", "period", "country", "work_type", "key", "catalog_number")


@query("p10_missing_composers", "works composers", """SELECT 'drop' AS strategy, CAST(count(composer_id) AS BIGINT) AS works, CAST((SELECT count(*) FROM composers) AS BIGINT) AS composers, CAST(0 AS BIGINT) AS unknown_works FROM works
 UNION ALL SELECT 'keep_null', count(*), (SELECT count(*) FROM composers), 0 FROM works
 UNION ALL SELECT 'create_unknown', count(*), (SELECT count(*) FROM composers) + 1, count(*) - count(composer_id) FROM works""")
def _(t: Tables):
    parts = []
    for s in ("drop", "keep_null", "create_unknown"):
        comps = t.composers.withColumn("total_works_count", F.lit(0).cast("bigint"))
        w, c = conform.handle_missing_composers(t.works, comps, s, unknown_id=-1)
        from ostinato.operators.shape import one_row
        row = one_row(w.agg(F.count("*").alias("works")), c.agg(F.count("*").alias("composers"), F.coalesce(F.sum(F.when(F.col("composer_id") == -1, F.col("total_works_count"))), F.lit(0)).alias("unknown_works")))
        parts.append(row.select(F.lit(s).alias("strategy"), "*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("p11_find_issues", "dirty_works", """SELECT 'uuid_title' AS type, work_id, title FROM dirty_works WHERE regexp_matches(title, '^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$', 'i')
 UNION ALL SELECT 'missing_title', work_id, title FROM dirty_works WHERE title IS NULL OR title = ''
 UNION ALL SELECT 'generic_title', work_id, title FROM dirty_works WHERE regexp_matches(title, 'Unknown|Untitled|Unnamed', 'i')""")
def _(t: Tables):
    return quality.find_issues(t.dirty_works)


@query("p11_issue_counts", "dirty_works", """SELECT 'uuid_title' AS type, CAST(count(*) AS BIGINT) AS n FROM dirty_works WHERE regexp_matches(title, '^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$', 'i')
 UNION ALL SELECT 'missing_title', count(*) FROM dirty_works WHERE title IS NULL OR title = ''
 UNION ALL SELECT 'generic_title', count(*) FROM dirty_works WHERE regexp_matches(title, 'Unknown|Untitled|Unnamed', 'i')
 UNION ALL SELECT 'duplicate_titles', count(*) FROM (SELECT title FROM dirty_works WHERE title IS NOT NULL GROUP BY title HAVING count(*) > 1)""")
def _(t: Tables):
    return quality.issue_counts(t.dirty_works)


@query("p12_rating_split", "", """SELECT CASE WHEN r IN (-1, 1) THEN 'accepted' ELSE 'rejected' END AS side, CAST(count(*) AS BIGINT) AS n, CAST(sum(r) AS BIGINT) AS total
 FROM (SELECT CAST(floor(value) % 3 AS INT) - 1 AS r FROM events) GROUP BY 1""")
def _(t: Tables):
    feedback = t.events.select((F.floor("value") % 3 - 1).cast("int").alias("rating"))
    ok, bad = catalog.split_ratings(feedback)
    both = ok.withColumn("side", F.lit("accepted")).unionByName(bad.withColumn("side", F.lit("rejected")))
    return both.groupBy("side").agg(F.count("*").alias("n"), F.sum("rating").alias("total"))


@query("j1_works_per_composer", "works composers", """SELECT c.composer_id, name, CAST(coalesce(n, 0) AS BIGINT) AS total_works_count FROM composers c
 LEFT JOIN (SELECT composer_id, count(*) AS n FROM works GROUP BY 1) w ON c.composer_id = w.composer_id""")
def _(t: Tables):
    return conform.count_works(t.composers, t.works).select("composer_id", "name", "total_works_count")


@query("j5_drop_orphan_tags", "works tags", "SELECT work_id, tag, source FROM tags WHERE work_id IN (SELECT work_id FROM works)")
def _(t: Tables):
    return conform.drop_orphan_tags(t.tags, t.works).select("work_id", "tag", "source")


@query("j6_orphan_tags", "works tags", "SELECT work_id, tag, source FROM tags WHERE work_id NOT IN (SELECT work_id FROM works)")
def _(t: Tables):
    return conform.orphan_tags(t.tags, t.works).select("work_id", "tag", "source")


J10_SQL = """, alias AS (SELECT lower(name) AS a, composer_id FROM composers),
 hit AS (SELECT w.work_id, min(x.composer_id) AS by_name FROM named_works w JOIN alias x ON w.composer_id IS NULL AND contains(lower(w.title), x.a) GROUP BY 1)
SELECT w.work_id, coalesce(w.composer_id, h.by_name, CASE WHEN contains(lower(title), 'bwv') THEN 1 WHEN contains(lower(title), 'rv') THEN 2 WHEN contains(lower(title), 'k.') THEN 3 END) AS composer_id
FROM named_works w LEFT JOIN hit h ON w.work_id = h.work_id"""


@query("j10_infer_composer_links", "named_works composers", J10_SQL)
def _(t: Tables):
    return conform.infer_composer_links(t.named_works, t.composers, {"bwv": 1, "rv": 2, "k.": 3}).select("work_id", "composer_id")


SIBLINGS = {"siblings": """SELECT w.work_id, w.catalog_number, s.work_id AS sibling_id, s.title AS sibling_title FROM dirty_works w JOIN dirty_works s
 ON w.catalog_number = s.catalog_number AND s.work_id <> w.work_id
 QUALIFY row_number() OVER (PARTITION BY w.work_id ORDER BY s.work_id) = 1"""}


@query("j11_catalog_siblings", "dirty_works", "SELECT work_id, catalog_number, sibling_id, sibling_title FROM siblings", SIBLINGS)
def _(t: Tables):
    return quality.catalog_siblings(t.dirty_works).filter("sibling_id IS NOT NULL")


# --- F: title enrichment -------------------------------------------------------------------------------

@query("f1_catalog_number", "works", "SELECT work_id, title, catalog_number FROM works")
def _(t: Tables):
    return enrich_titles(t.raw_works).select("work_id", "title", "catalog_number")


def _sql_all_numbers() -> str:
    from ostinato.functions.fixed_values import CATALOG_NUMBER_PATTERNS
    out = "CAST([] AS VARCHAR[])"
    for p, prefix in CATALOG_NUMBER_PATTERNS:
        out = f"list_concat({out}, list_transform(regexp_extract_all(title, '{_re2(p)}', 1, 'i'), lambda n: concat('{prefix} ', trim(n))))"
    return f"array_to_string({out}, '|')"


@query("f1_all_catalog_numbers", "raw_works", f"SELECT work_id, {_sql_all_numbers()} AS numbers FROM raw_works")
def _(t: Tables):
    return t.raw_works.select("work_id", F.array_join(all_catalog_numbers("title"), "|").alias("numbers"))


@query("f2_work_type", "works", "SELECT work_id, title, work_type FROM works")
def _(t: Tables):
    return enrich_titles(t.raw_works).select("work_id", "title", "work_type")


def _sql_all_types() -> str:
    seen: dict[str, list[str]] = {}
    from ostinato.functions.fixed_values import WORK_TYPE_PATTERNS
    for name, ps in WORK_TYPE_PATTERNS:
        seen[name] = [f"regexp_matches(title, '{_re2(p)}', 'i')" for p in ps if all(ord(c) < 128 for c in p)]
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {' OR '.join(v)} THEN '{k}' END" for k, v in seen.items()) + ")"


@query("f2_all_work_types", "raw_works", f"SELECT work_id, {_sql_all_types()} AS types FROM raw_works")
def _(t: Tables):
    return t.raw_works.select("work_id", F.array_join(all_work_types("title"), "|").alias("types"))


NOT_WORD = r"[^\p{L}\p{M}\p{Nd}_]"


def unicode_pattern(p: str) -> str:
    """A rule as a yes/no pattern with spelled-out Unicode word borders and look-aheads."""
    p = p.replace(r"(?!\s+/)", r"(?:$|\S|\s+$|\s+[^\s/])")
    p = p.replace(r"\b(?!\s+pour)", rf"(?:$|[^\p{{L}}\p{{M}}\p{{Nd}}_\s]|\s+$|\s+(?:[^\sp]|p$|p[^o]|po$|po[^u]|pou$|pou[^r]))")
    if p.startswith(r"\b"):
        p = rf"(?:^|{NOT_WORD})" + p[2:]
    if p.endswith(r"\b"):
        p = p[:-2] + rf"(?:$|{NOT_WORD})"
    return p.replace("'", "''")


@query("f2_work_type_of_documents", "", "SELECT doc_id, CASE " + " ".join(
    f"WHEN regexp_matches(\"text\", '{unicode_pattern(p)}', 'i') THEN '{n}'" for p, n in all_rules()) + " END AS work_type FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", work_type("text").alias("work_type"))


@query("f3_musical_key", "works", "SELECT work_id, title, key FROM works")
def _(t: Tables):
    return enrich_titles(t.raw_works).select("work_id", "title", "key")


@query("f4_period", "composers", "SELECT composer_id, birth_year, death_year, period FROM composers")
def _(t: Tables):
    b = year_of(F.concat(F.col("birth_year").cast(STR), F.lit("-01-31")))
    d = year_of(F.col("death_year").cast(STR))
    return t.composers.select("composer_id", b.alias("birth_year"), d.alias("death_year"), period_of(b, d).alias("period"))


@query("f5_repair_titles", "dirty_works", """SELECT w.work_id, CASE WHEN regexp_matches(title, '^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$', 'i') THEN
 coalesce(CASE WHEN NOT starts_with(sibling_title, substr(title, 1, 8)) THEN sibling_title || ' (alternate)' END,
  work_type || ' ' || w.catalog_number, work_type || ' in ' || key, 'Unknown Work (' || coalesce(w.catalog_number, 'None') || ')') ELSE title END AS title
 FROM dirty_works w LEFT JOIN siblings s ON w.work_id = s.work_id""", SIBLINGS)
def _(t: Tables):
    return quality.repair_titles(t.dirty_works).select("work_id", "title")


# --- A1-A5, W2, W6 ------------------------------------------------------------------------------------------

@query("a1_profile_composers", "composers", """SELECT CAST(count(*) AS BIGINT) AS total_composers, CAST(count(birth_year) AS BIGINT) AS with_birth_year,
 CAST(count(death_year) AS BIGINT) AS with_death_year, CAST(count(period) AS BIGINT) AS with_period, CAST(count(*) - count(DISTINCT composer_id) AS BIGINT) AS duplicate_composers,
 CAST(count(*) - count(composer_id) AS BIGINT) AS missing_composer_ids, round(100.0 * count(death_year) / count(*), 2) AS death_year_pct FROM composers""")
def _(t: Tables):
    return quality.profile_composers(t.composers).select(
        "total_composers", "with_birth_year", "with_death_year", "with_period", "duplicate_composers", "missing_composer_ids", "death_year_pct")


@query("a2_profile_works", "dirty_works", """SELECT CAST(count(*) AS BIGINT) AS total_works, CAST(count(catalog_number) AS BIGINT) AS with_catalog_number,
 CAST(count(work_type) AS BIGINT) AS with_work_type, CAST(count(key) AS BIGINT) AS with_key, CAST(count(*) - count(DISTINCT id) AS BIGINT) AS duplicate_works,
 round(100.0 * count(catalog_number) / count(*), 2) AS catalog_number_pct, concat('Found ', count(*) - count(DISTINCT id), ' duplicate work IDs') AS work_warnings
 FROM (SELECT *, work_id % 50000000 AS id FROM dirty_works)""")
def _(t: Tables):
    w = t.dirty_works.withColumn("work_id", F.col("work_id") % 50000000)
    return quality.profile_works(w).select(
        "total_works", "with_catalog_number", "with_work_type", "with_key", "duplicate_works", "catalog_number_pct",
        F.array_join("work_warnings", "|").alias("work_warnings"))


@query("a3_profile_recordings", "history", """SELECT CAST(count(*) AS BIGINT) AS total_recordings, CAST(count(p) AS BIGINT) AS with_popularity,
 CAST(count(*) - count(DISTINCT work_id) AS BIGINT) AS duplicate_recordings, CAST((SELECT count(*) FROM embeddings) AS BIGINT) AS with_audio_features, round(100.0 * count(p) / count(*), 2) AS popularity_pct
 FROM (SELECT work_id, CASE WHEN relevance_score > 0.02 THEN relevance_score END AS p FROM history)""")
def _(t: Tables):
    rec = t.history.select(F.col("work_id").alias("recording_id"), F.when(F.col("relevance_score") > 0.02, F.col("relevance_score")).alias("popularity"))
    return quality.profile_recordings(rec, t.embeddings, t.works).select(
        "total_recordings", "with_popularity", "duplicate_recordings", "with_audio_features", "popularity_pct")


@query("a3_validate_all", "works composers", """SELECT CAST((SELECT count(*) FROM works) AS BIGINT) AS total_works, CAST((SELECT count(*) FROM composers) AS BIGINT) AS total_composers,
 CAST(0 AS BIGINT) AS total_recordings, CAST(0 AS BIGINT) AS errors""")
def _(t: Tables):
    return quality.profile_all(t.composers, t.works).select("total_works", "total_composers", "total_recordings", F.size("errors").cast("bigint").alias("errors"))


@query("a4_load_report", "works composers tags", """SELECT CAST((SELECT count(*) FROM works) AS BIGINT) AS total_works, CAST((SELECT count(*) FROM composers) AS BIGINT) AS total_composers,
 CAST((SELECT count(*) FROM tags) AS BIGINT) AS total_tags, CAST((SELECT count(*) FROM works WHERE composer_id IS NULL) AS BIGINT) AS works_missing_composer,
 CAST(0 AS BIGINT) AS works_missing_title, CAST((SELECT count(*) FROM works WHERE work_type IS NULL) AS BIGINT) AS works_missing_work_type,
 CAST((SELECT count(*) FROM works WHERE key IS NULL) AS BIGINT) AS works_missing_key,
 CAST((SELECT count(*) FROM works WHERE work_id NOT IN (SELECT work_id FROM tags)) AS BIGINT) AS works_with_no_tags,
 CAST((SELECT count(*) FROM works) - (SELECT count(*) FROM (SELECT DISTINCT title, composer_id FROM works)) AS BIGINT) AS duplicate_works,
 CAST((SELECT count(*) FROM tags WHERE work_id NOT IN (SELECT work_id FROM works)) AS BIGINT) AS orphaned_tags,
 CAST((SELECT count(*) FROM composers WHERE composer_id NOT IN (SELECT composer_id FROM works WHERE composer_id IS NOT NULL)) AS BIGINT) AS composers_with_no_works,
 (SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM tags GROUP BY work_id)) AS avg_tags_per_work,
 (SELECT CAST(median(n) AS DOUBLE) FROM (SELECT count(*) AS n FROM tags GROUP BY work_id)) AS median_tags_per_work,
 CAST((SELECT count(DISTINCT tag) FROM tags) AS BIGINT) AS unique_tags""")
def _(t: Tables):
    return quality.load_report(t.works, t.composers, t.tags).withColumn("avg_tags_per_work", F.round("avg_tags_per_work", 6))


@query("a5_value_distributions", "works composers tags", """SELECT 'work_type' AS facet, coalesce(work_type, 'Unknown') AS value, CAST(count(*) AS BIGINT) AS n FROM works GROUP BY 2
 UNION ALL SELECT 'key', coalesce(key, 'Unknown'), count(*) FROM works GROUP BY 2
 UNION ALL SELECT 'period', coalesce(period, 'Unknown'), count(*) FROM works LEFT JOIN composers USING (composer_id) GROUP BY 2
 UNION ALL SELECT 'source', source, count(*) FROM tags GROUP BY 2
 UNION ALL (SELECT 'tag', tag, count(*) AS n FROM tags GROUP BY 2 ORDER BY n DESC, tag LIMIT 20)""")
def _(t: Tables):
    def facet(name, df):
        return df.select(F.lit(name).alias("facet"), "value", "n")

    j = catalog.with_composers(t.works, t.composers, ["period"])
    return (facet("work_type", quality.value_counts(t.works, "work_type")).unionAll(facet("key", quality.value_counts(t.works, "key")))
            .unionAll(facet("period", quality.value_counts(j, "period"))).unionAll(facet("source", quality.value_counts(t.tags, "source", None)))
            .unionAll(facet("tag", quality.value_counts(t.tags, "tag", None).limit(20))))


@query("a5_duplicate_titles", "dirty_works", "SELECT title, CAST(count(*) AS BIGINT) AS n FROM dirty_works WHERE title IS NOT NULL GROUP BY title HAVING count(*) > 1")
def _(t: Tables):
    return quality.duplicate_titles(t.dirty_works)


@query("w2_deduplicate_works", "dirty_works", "SELECT work_id, title, composer_id FROM dirty_works QUALIFY row_number() OVER (PARTITION BY title, composer_id ORDER BY work_id) = 1")
def _(t: Tables):
    return conform.drop_duplicate_works(t.dirty_works).select("work_id", "title", "composer_id")


@query("w6_flag_duplicates", "dirty_works", """SELECT work_id, CAST(count(*) OVER (PARTITION BY title, composer_id) AS BIGINT) AS copies,
 work_id <> min(work_id) OVER (PARTITION BY title, composer_id) AS is_duplicate FROM dirty_works""")
def _(t: Tables):
    return quality.flag_duplicates(t.dirty_works, ["title", "composer_id"], "work_id").select("work_id", "copies", "is_duplicate")


@query("clean_catalog", "dirty_works composers tags", """, w AS (SELECT * FROM dirty_works QUALIFY row_number() OVER (PARTITION BY title, composer_id ORDER BY work_id) = 1)
SELECT 'works' AS "table", CAST(count(*) AS BIGINT) AS n FROM w UNION ALL SELECT 'composers', count(*) + 1 FROM composers
UNION ALL SELECT 'tags', count(*) FROM tags WHERE work_id IN (SELECT work_id FROM w)""")
def _(t: Tables):
    w, c, g = conform.clean(t.dirty_works, t.composers, t.tags, unknown_id=-1)
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(n).alias("table"), "n") for n, d in (("works", w), ("composers", c), ("tags", g))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])
