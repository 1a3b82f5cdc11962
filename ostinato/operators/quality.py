"""Data quality: completeness profiles, load report, issue finder, title repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ostinato.functions.fixed_values import GENERIC_TITLE, UUID_TITLE
from ostinato.operators.shape import one_row, pct


def _duplicates(id_col: str) -> Column:
    """Rows beyond the first of each id, null being one id."""
    null_id = F.when(F.count_if(F.col(id_col).isNull()) > 0, 1).otherwise(0)
    return F.count("*") - F.count_distinct(id_col) - null_id


def _present(df: DataFrame, name: str, test: Column) -> Column:
    return F.count_if(test) if name in df.columns else F.lit(0).cast("bigint")


def _messages(*pairs: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(test, text) for test, text in pairs]))


def profile_composers(composers: DataFrame) -> DataFrame:
    """One row: totals, non-null counts and percentages, duplicates, warnings and errors."""
    base = composers.agg(
        F.count("*").alias("total_composers"),
        _present(composers, "birth_year", F.col("birth_year").isNotNull()).alias("with_birth_year"),
        _present(composers, "death_year", F.col("death_year").isNotNull()).alias("with_death_year"),
        _present(composers, "period", F.col("period").isNotNull()).alias("with_period"),
        _present(composers, "mb_tags", F.size("mb_tags") > 0).alias("with_tags"),
        _duplicates("composer_id").alias("duplicate_composers"),
        F.count_if(F.col("composer_id").isNull()).alias("missing_composer_ids"),
    )
    total = F.col("total_composers")
    return base.select(
        "*",
        *[pct(F.col(f"with_{c}"), total).alias(f"{c}_pct") for c in ("birth_year", "death_year", "period", "tags")],
        _messages((F.col("duplicate_composers") > 0,
                   F.format_string("Found %d duplicate composer IDs", "duplicate_composers"))).alias("composer_warnings"),
        _messages((F.col("missing_composer_ids") > 0,
                   F.format_string("Found %d composers with null IDs", "missing_composer_ids"))).alias("composer_errors"),
    )


def profile_works(works: DataFrame) -> DataFrame:
    base = works.agg(
        F.count("*").alias("total_works"),
        _present(works, "catalog_number", F.col("catalog_number").isNotNull()).alias("with_catalog_number"),
        _present(works, "work_type", F.col("work_type").isNotNull()).alias("with_work_type"),
        _present(works, "key", F.col("key").isNotNull()).alias("with_key"),
        _present(works, "mb_tags", F.size("mb_tags") > 0).alias("with_work_tags"),
        _present(works, "recording_count", F.col("recording_count") > 0).alias("with_recordings"),
        _duplicates("work_id").alias("duplicate_works"),
        F.count_if(F.col("work_id").isNull()).alias("missing_work_ids"),
    )
    total = F.col("total_works")
    names = ("catalog_number", "work_type", "key", "work_tags", "recordings")
    return base.select(
        "*",
        *[pct(F.col(f"with_{c}"), total).alias(f"{c}_pct") for c in names],
        _messages((F.col("duplicate_works") > 0,
                   F.format_string("Found %d duplicate work IDs", "duplicate_works"))).alias("work_warnings"),
        _messages((F.col("missing_work_ids") > 0,
                   F.format_string("Found %d works with null IDs", "missing_work_ids"))).alias("work_errors"),
    )


def profile_recordings(recordings: DataFrame | None, audio_features: DataFrame | None, like: DataFrame) -> DataFrame:
    """Recording duplicates and popularity, and the number of audio feature rows; both may be absent."""
    spark = like.sparkSession
    if recordings is None:
        recordings = spark.createDataFrame([], "recording_id string, popularity double")
    base = recordings.agg(
        F.count("*").alias("total_recordings"),
        _present(recordings, "popularity", F.col("popularity").isNotNull()).alias("with_popularity"),
        (_duplicates("recording_id") if "recording_id" in recordings.columns else F.lit(0).cast("bigint")).alias(
            "duplicate_recordings"),
    )
    if audio_features is None:
        audio = base.select(F.lit(0).cast("bigint").alias("with_audio_features"))
    else:
        audio = audio_features.agg(F.count("*").alias("with_audio_features"))
    row = one_row(base, audio)
    return row.select(
        "*",
        pct(F.col("with_audio_features"), F.col("total_recordings")).alias("audio_features_pct"),
        pct(F.col("with_popularity"), F.col("total_recordings")).alias("popularity_pct"),
        _messages((F.col("duplicate_recordings") > 0,
                   F.format_string("Found %d duplicate recording IDs", "duplicate_recordings"))).alias("recording_warnings"),
    )


def profile_all(
    composers: DataFrame, works: DataFrame, recordings: DataFrame | None = None, audio_features: DataFrame | None = None
) -> DataFrame:
    """The three profiles as one row, with joined ``errors`` and ``warnings``."""
    row = one_row(profile_composers(composers), profile_works(works), profile_recordings(recordings, audio_features, works))
    return row.withColumns({
        "errors": F.concat("composer_errors", "work_errors"),
        "warnings": F.concat("composer_warnings", "work_warnings", "recording_warnings"),
    }).drop("composer_errors", "work_errors", "composer_warnings", "work_warnings", "recording_warnings")


def load_report(works: DataFrame, composers: DataFrame, tags: DataFrame) -> DataFrame:
    """One row: totals, missing values, duplicates, orphans, tags per tagged work."""
    w = works.agg(
        F.count("*").alias("total_works"),
        F.count_if(F.col("composer_id").isNull()).alias("works_missing_composer"),
        F.count_if(F.col("title").isNull()).alias("works_missing_title"),
        (F.count_if(F.col("work_type").isNull()) if "work_type" in works.columns else F.count("*")).alias("works_missing_work_type"),
        (F.count_if(F.col("key").isNull()) if "key" in works.columns else F.count("*")).alias("works_missing_key"),
        (F.count("*") - F.count_distinct(F.struct("title", "composer_id"))).alias("duplicate_works"),
    )
    c = composers.agg(F.count("*").alias("total_composers"))
    per_work = tags.groupBy("work_id").agg(F.count("*").alias("n"))
    t = per_work.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_tags"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_tags_per_work"),
        F.coalesce(F.median("n"), F.lit(0.0)).alias("median_tags_per_work"),
    )
    ids = works.select("work_id").distinct()
    known = per_work.join(ids, "work_id", "left_semi").agg(
        F.count("*").alias("_tagged_known"), F.coalesce(F.sum("n"), F.lit(0)).alias("_tags_known"))
    u = tags.agg(F.count_distinct("tag").alias("unique_tags"))
    used = works.select("composer_id").distinct().join(composers.select("composer_id"), "composer_id", "left_semi").agg(
        F.count("*").alias("_used_composers"))
    row = one_row(w, c, t, known, u, used)
    return row.select(
        "total_works", "total_composers", "total_tags", "works_missing_composer", "works_missing_title",
        "works_missing_work_type", "works_missing_key",
        (F.col("total_works") - F.col("_tagged_known")).alias("works_with_no_tags"),
        "duplicate_works",
        (F.col("total_tags") - F.col("_tags_known")).alias("orphaned_tags"),
        (F.col("total_composers") - F.col("_used_composers")).alias("composers_with_no_works"),
        "avg_tags_per_work", "median_tags_per_work", "unique_tags",
    )


def value_counts(df: DataFrame, column: str, unknown: str | None = "Unknown") -> DataFrame:
    """``(value, n)``, most frequent first, nulls under ``unknown``."""
    value = F.coalesce(F.col(column), F.lit(unknown)) if unknown is not None else F.col(column)
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("value"))


def duplicate_titles(works: DataFrame) -> DataFrame:
    """Titles that occur more than once, with their counts."""
    return works.filter("title IS NOT NULL").groupBy("title").agg(F.count("*").alias("n")).filter("n > 1")


def flag_duplicates(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add ``copies`` (rows with the same keys) and ``is_duplicate`` (not the first of them).

    Counts and first rows come from a grouped table joined back, so a hot key is never one task's window.
    """
    stats = df.groupBy(*keys).agg(F.count("*").alias("copies"), F.min(order).alias("_first"))
    a, b = df.alias("a"), stats.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    out = a.join(b, same)
    return out.select("a.*", "b.copies", (F.col(f"a.{order}") != F.col("b._first")).alias("is_duplicate"))


def is_uuid(title: Column) -> Column:
    return F.coalesce(F.lower(title).rlike(UUID_TITLE), F.lit(False))


def find_issues(works: DataFrame) -> DataFrame:
    """Long ``(type, work_id, title)``: UUID, missing and generic titles."""
    t = F.col("title")
    kinds = F.array_compact(F.array(
        F.when(is_uuid(t), F.lit("uuid_title")),
        F.when(t.isNull() | (t == ""), F.lit("missing_title")),
        F.when(t.rlike("(?i)" + GENERIC_TITLE), F.lit("generic_title")),
    ))
    return works.select(F.explode(kinds).alias("type"), "work_id", "title")


def issue_counts(works: DataFrame) -> DataFrame:
    """Rows per issue type, with the number of duplicate titles as one more type."""
    by_type = find_issues(works).groupBy("type").agg(F.count("*").alias("n"))
    dup = duplicate_titles(works).agg(F.count("*").alias("n")).select(F.lit("duplicate_titles").alias("type"), "n")
    return by_type.unionByName(dup)


def catalog_siblings(works: DataFrame, order: str = "work_id") -> DataFrame:
    """For each work the first other work with the same catalogue number: ``(work_id, sibling_title)``.

    Only the two first works of a number can be a sibling, so just these meet the works.
    """
    numbered = works.filter("catalog_number IS NOT NULL")
    w = Window.partitionBy("catalog_number").orderBy(order)
    two = (
        numbered.select("catalog_number", order, "title").withColumn("_rn", F.row_number().over(w)).filter("_rn <= 2")
        .groupBy("catalog_number").agg(
            F.max(F.when(F.col("_rn") == 1, F.struct(F.col(order).alias("id"), "title"))).alias("one"),
            F.max(F.when(F.col("_rn") == 2, F.struct(F.col(order).alias("id"), "title"))).alias("two"),
        )
    )
    pick = F.when(F.col("one.id") != F.col(order), F.col("one")).otherwise(F.col("two"))
    return numbered.join(two, "catalog_number").select(
        "work_id", "catalog_number", pick["id"].alias("sibling_id"), pick["title"].alias("sibling_title"))


def repair_titles(works: DataFrame, order: str = "work_id") -> DataFrame:
    """Replace UUID titles: sibling's title, else type and number, else type and key, else a mark.

    Siblings are looked up for the UUID rows only, against the two first works of each number.
    """
    bad = works.filter(is_uuid(F.col("title")))
    two = (
        works.filter("catalog_number IS NOT NULL")
        .join(bad.select("catalog_number").distinct(), "catalog_number", "left_semi")
        .select("catalog_number", F.col(order).alias("_id"), F.col("title").alias("_t"))
        .withColumn("_rn", F.row_number().over(Window.partitionBy("catalog_number").orderBy("_id"))).filter("_rn <= 2")
        .groupBy("catalog_number").agg(
            F.max(F.when(F.col("_rn") == 1, F.struct("_id", "_t"))).alias("one"),
            F.max(F.when(F.col("_rn") == 2, F.struct("_id", "_t"))).alias("two"))
    )
    fixed = bad.join(two, "catalog_number", "left")
    sib = F.when(F.col("one._id") != F.col(order), F.col("one._t")).otherwise(F.col("two._t"))
    usable = sib.isNotNull() & ~sib.startswith(F.substring("title", 1, 8))
    new = F.coalesce(
        F.when(usable, F.concat(sib, F.lit(" (alternate)"))),
        F.concat(F.col("work_type"), F.lit(" "), F.col("catalog_number")),
        F.concat(F.col("work_type"), F.lit(" in "), F.col("key")),
        F.concat(F.lit("Unknown Work ("), F.coalesce("catalog_number", F.lit("None")), F.lit(")")),
    )
    fixed = fixed.withColumn("title", new).select(*works.columns)
    return works.filter(~is_uuid(F.col("title"))).unionByName(fixed)
