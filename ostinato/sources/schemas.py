"""Table and document schemas."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType, TimestampType

TEXT = StringType()
TEXTS = ArrayType(TEXT)

WORKS = (
    StructType()
    .add("work_id", TEXT)
    .add("composer_id", TEXT)
    .add("title", TEXT)
    .add("work_type", TEXT)
    .add("catalog_number", TEXT)
    .add("key", TEXT)
    .add("mb_tags", TEXTS)
)

COMPOSERS = (
    StructType()
    .add("composer_id", TEXT)
    .add("name", TEXT)
    .add("sort_name", TEXT)
    .add("birth_year", IntegerType())
    .add("death_year", IntegerType())
    .add("country", TEXT)
    .add("period", TEXT)
    .add("annotation", TEXT)
    .add("mb_tags", TEXTS)
    .add("total_works_count", LongType())
)

PLAIN_TAGS = StructType().add("work_id", TEXT).add("tag", TEXT).add("source", TEXT)

TAGS = (
    StructType()
    .add("work_id", TEXT)
    .add("tag", TEXT)
    .add("source", TEXT)
    .add("confidence", DoubleType())
    .add("created_at", TimestampType())
)

CORRECTIONS = (
    StructType()
    .add("work_id", TEXT)
    .add("title", TEXT)
    .add("composer_id", TEXT)
    .add("work_type", TEXT)
    .add("key", TEXT)
    .add("catalog_number", TEXT)
    .add("auto_tags", TEXTS)
    .add("corrected_tags", TEXTS)
    .add("removed", TEXTS)
    .add("added", TEXTS)
    .add("reason", TEXT)
    .add("reviewer", TEXT)
    .add("timestamp", TEXT)
)

LIFE_SPAN = StructType().add("begin", TEXT).add("end", TEXT)

ARTIST = (
    StructType()
    .add("source", TEXT)
    .add("artist_id", TEXT)
    .add("musicbrainz_id", TEXT)
    .add("name", TEXT)
    .add("sort_name", TEXT)
    .add("type", TEXT)
    .add("country", TEXT)
    .add("life_span", LIFE_SPAN)
    .add("tags", TEXTS)
    .add("musicbrainz_tags", TEXTS)
    .add("annotation", TEXT)
    .add("disambiguation", TEXT)
)

ARTIST_WORK = (
    StructType()
    .add("source", TEXT)
    .add("release_group_id", TEXT)
    .add("musicbrainz_id", TEXT)
    .add("title", TEXT)
    .add("primary_type", TEXT)
    .add("type", TEXT)
    .add("first_release_date", TEXT)
    .add("release_date", TEXT)
    .add("annotation", TEXT)
    .add("secondary_types", TEXTS)
    .add("tags", TEXTS)
)

ARTIST_DOCUMENT = (
    StructType()
    .add("artist", ARTIST)
    .add("works", ArrayType(ARTIST_WORK))
    .add("metadata", StructType().add("extraction_timestamp", TEXT).add("sources", TEXTS))
    .add("extraction_timestamp", TEXT)
)

# raw source records, with the hyphenated field names of the source
NAMED = ArrayType(StructType().add("name", TEXT))

RAW_ARTIST = (
    StructType()
    .add("id", TEXT)
    .add("name", TEXT)
    .add("sort-name", TEXT)
    .add("type", TEXT)
    .add("country", TEXT)
    .add("life-span", LIFE_SPAN)
    .add("tag-list", NAMED)
    .add("annotation", TEXT)
    .add("disambiguation", TEXT)
)

RAW_RELEASE = (
    StructType()
    .add("id", TEXT)
    .add("title", TEXT)
    .add("type", TEXT)
    .add("secondary-type-list", TEXTS)
    .add("first-release-date", TEXT)
    .add("tag-list", NAMED)
    .add("annotation", TEXT)
)
