"""Raw documents to conformed tables, composer link inference, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.functions.fixed_values import CATALOG_COMPOSERS
from ostinato.functions.titles import enrich_titles, period_of, year_of
from ostinato.operators.shape import first_per_key

UNKNOWN_COMPOSER = "unknown-composer"


def _id(*cols: str) -> Column:
    """First id that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols])


def _column(df: DataFrame, name: str, dtype: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def _annotation(c: Column) -> Column:
    """Text of an annotation that may be plain text or a JSON object with ``text``."""
    is_object = F.get_json_object(c, "$").startswith("{")
    return F.when(is_object, F.coalesce(F.get_json_object(c, "$.text"), F.lit(""))).otherwise(c)


def conform_composers(artists: DataFrame, works: DataFrame | None = None) -> DataFrame:
    """Composer rows from artist records; rows without an id are dropped."""
    empty = F.array().cast("array<string>")
    tags = F.coalesce(_column(artists, "musicbrainz_tags", "array<string>"), _column(artists, "tags", "array<string>"), empty)
    base = artists.select(
        _id("musicbrainz_id", "artist_id").alias("composer_id"),
        F.col("name"),
        _column(artists, "sort_name", "string").alias("sort_name"),
        year_of(F.col("life_span.begin")).alias("birth_year"),
        year_of(F.col("life_span.end")).alias("death_year"),
        _column(artists, "country", "string").alias("country"),
        _annotation(_column(artists, "annotation", "string")).alias("annotation"),
        tags.alias("mb_tags"),
    ).filter(F.col("composer_id").isNotNull())
    base = base.withColumn("period", period_of("birth_year", "death_year"))
    base = base.withColumn("total_works_count", F.lit(0).cast("bigint")) if works is None else count_works(base, works)
    return base.select(
        "composer_id", "name", "sort_name", "birth_year", "death_year", "country", "period", "annotation", "mb_tags",
        "total_works_count",
    )


def count_works(composers: DataFrame, works: DataFrame) -> DataFrame:
    """Add the number of works per composer (0 when none)."""
    counts = works.groupBy("composer_id").agg(F.count("*").alias("total_works_count"))
    return composers.join(counts, "composer_id", "left").withColumn(
        "total_works_count", F.coalesce("total_works_count", F.lit(0)).cast("bigint")
    )


def conform_works(raw: DataFrame, strict_keys: bool = False) -> DataFrame:
    """Work rows from raw works: id, title, facts read from the title, source tags."""
    base = raw.select(
        _id("musicbrainz_id", "release_group_id").alias("work_id"),
        "composer_id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("mb_tags"),
    ).filter(F.col("work_id").isNotNull())
    return enrich_titles(base, strict=strict_keys).select(
        "work_id", "composer_id", "title", "work_type", "catalog_number", "key", "mb_tags"
    )


def conform_tags(raw: DataFrame) -> DataFrame:
    """Distinct ``(work_id, tag, source)`` rows of the works' tag lists."""
    return (
        raw.select(
            _id("musicbrainz_id", "release_group_id").alias("work_id"),
            F.explode("tags").alias("tag"),
            F.coalesce("source", F.lit("musicbrainz")).alias("source"),
        )
        .filter(F.col("work_id").isNotNull())
        .distinct()
    )


# --- composer links ------------------------------------------------------------------------------

def composer_aliases(composers: DataFrame, order: str = "composer_id") -> DataFrame:
    """``(alias, ord, composer_id)``: full name, last name and "Last, First", all lower-case.

    ``ord`` is the first position an alias takes in build order.  A full or sorted name belongs to
    the last composer that writes it, a last name only to the first one.
    """
    words = F.split(F.trim("name"), r"\s+")
    last = F.element_at(words, -1)
    first = F.array_join(F.slice(words, 1, F.size(words) - 1), " ")
    many = F.size(words) > 1

    def entry(alias: Column, slot: int, overwrites: bool, when: Column | None = None) -> Column:
        s = F.struct(F.lower(alias).alias("alias"), F.lit(slot).alias("slot"), F.lit(overwrites).alias("overwrites"))
        return s if when is None else F.when(when, s)

    entries = F.array_compact(F.array(
        entry(F.col("name"), 0, True),
        entry(last, 1, False, many),
        entry(F.concat(last, F.lit(", "), first), 2, True, many & ~F.col("name").contains(",")),
    ))
    rows = composers.filter(F.col("name").isNotNull()).select(
        F.col(order).alias("_o"), "composer_id", F.explode(entries).alias("e")
    ).select("_o", "composer_id", "e.*")
    pos = F.struct("_o", "slot")
    best = rows.groupBy("alias").agg(
        F.min(pos).alias("ord"),
        F.max_by(F.when(F.col("overwrites"), F.col("composer_id")), F.when(F.col("overwrites"), pos)).alias("writer"),
        F.min_by("composer_id", pos).alias("first_writer"),
    )
    return best.select("alias", "ord", F.coalesce("writer", "first_writer").alias("composer_id"))


#: Length of the pieces by which titles and aliases meet.
GRAM = 4


def grams(text: Column, n: int) -> Column:
    """The different pieces of n characters."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda p: F.substr(text, p, F.lit(n))))).otherwise(
        F.array().cast("array<string>"))


def alias_index(aliases: DataFrame) -> DataFrame:
    """Each alias under one gram, the one that the fewest aliases have; shorter aliases are their own gram."""
    own = F.when(F.length("alias") < GRAM, F.array("alias")).otherwise(grams(F.col("alias"), GRAM))
    rows = aliases.select("alias", "ord", "composer_id", F.explode(own).alias("gram"))
    shared = rows.groupBy("gram").agg(F.count("*").alias("n"))
    return rows.join(shared, "gram").groupBy("alias", "ord", "composer_id").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))


def title_grams(titles: DataFrame, short: list[int]) -> DataFrame:
    """Rows (work_id, t, gram): about one a character of the title, and one more for each length of a short alias."""
    t = F.lower("title")
    pieces = F.concat(*[grams(t, n) for n in [*short, GRAM]])
    return titles.select("work_id", t.alias("t"), F.explode(pieces).alias("gram"))


def infer_composer_links(
    works: DataFrame, composers: DataFrame, catalog_map: dict | None = None, order: str = "composer_id"
) -> DataFrame:
    """Fill missing ``composer_id`` from names found in titles, then from catalogue prefixes.

    The substring search is an equi-join on grams: an alias stands under its rarest gram only, so the few aliases that a
    title meets are then looked for in it.
    """
    catalog_map = CATALOG_COMPOSERS if catalog_map is None else catalog_map
    id_type = works.schema["composer_id"].dataType
    aliases = composer_aliases(composers, order).filter(F.length("alias") > 0)
    short = sorted(r[0] for r in aliases.select(F.length("alias").alias("n")).filter(F.col("n") < GRAM).distinct().collect())  # at most three
    missing = works.filter("composer_id IS NULL AND title IS NOT NULL")
    found = (
        title_grams(missing, short).join(alias_index(aliases), "gram").filter(F.contains("t", "alias"))
        .groupBy("work_id").agg(F.min_by("composer_id", "ord").alias("_by_name"))
    )
    works = works.join(found, "work_id", "left")
    t = F.lower("title")
    prefixes = [F.when(t.contains(p), F.lit(c).cast(id_type)) for p, c in catalog_map.items() if c is not None]
    by_catalog = F.coalesce(*prefixes) if prefixes else F.lit(None).cast(id_type)
    return works.withColumn("composer_id", F.coalesce("composer_id", "_by_name", by_catalog)).drop("_by_name")


# --- cleaning --------------------------------------------------------------------------------------

def drop_duplicate_works(works: DataFrame, order: str = "work_id") -> DataFrame:
    """Keep the first work of each (title, composer_id); nulls are equal."""
    return first_per_key(works, ["title", "composer_id"], [F.col(order)])


def handle_missing_composers(
    works: DataFrame, composers: DataFrame, strategy: str = "create_unknown", unknown_id=UNKNOWN_COMPOSER
) -> tuple[DataFrame, DataFrame]:
    """``drop`` the works without composer, ``create_unknown`` one for them, or ``keep_null``."""
    if strategy == "drop":
        return works.filter("composer_id IS NOT NULL"), composers
    if strategy == "keep_null":
        return works, composers
    if strategy != "create_unknown":
        raise ValueError(f"unknown strategy: {strategy}")
    id_type = works.schema["composer_id"].dataType
    named = {"name": "Unknown", "sort_name": "Unknown", "period": "Unknown"}
    count = works.agg(F.count_if(F.col("composer_id").isNull()).alias("total_works_count")).filter("total_works_count > 0")
    cols = []
    for f in composers.schema:
        if f.name == "composer_id":
            c = F.lit(unknown_id)
        elif f.name == "total_works_count":
            c = F.col("total_works_count")
        elif f.name == "mb_tags":
            c = F.array()
        else:
            c = F.lit(named.get(f.name))
        cols.append(c.cast(f.dataType).alias(f.name))
    filled = works.withColumn("composer_id", F.coalesce("composer_id", F.lit(unknown_id).cast(id_type)))
    return filled, composers.unionByName(count.select(*cols))


def drop_orphan_tags(tags: DataFrame, works: DataFrame) -> DataFrame:
    return tags.join(works.select("work_id"), "work_id", "left_semi")


def orphan_tags(tags: DataFrame, works: DataFrame) -> DataFrame:
    return tags.join(works.select("work_id"), "work_id", "left_anti")


def normalise_works(works: DataFrame) -> DataFrame:
    rules = {"title": F.trim("title"), "work_type": F.lower(F.trim("work_type")), "key": F.trim("key")}
    return works.withColumns({c: e for c, e in rules.items() if c in works.columns})


def normalise_composers(composers: DataFrame) -> DataFrame:
    rules = {"name": F.trim("name"), "period": F.trim("period")}
    return composers.withColumns({c: e for c, e in rules.items() if c in composers.columns})


def normalise_tags(tags: DataFrame) -> DataFrame:
    return tags.withColumn("tag", F.lower(F.trim("tag")))


def clean(
    works: DataFrame, composers: DataFrame, tags: DataFrame, strategy: str = "create_unknown", deduplicate: bool = True,
    unknown_id=UNKNOWN_COMPOSER, order: str = "work_id",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Duplicates out, missing composers handled, orphan tags out, texts normalised."""
    if deduplicate:
        works = drop_duplicate_works(works, order)
    works, composers = handle_missing_composers(works, composers, strategy, unknown_id)
    tags = drop_orphan_tags(tags, works)
    return normalise_works(works), normalise_composers(composers), normalise_tags(tags)
