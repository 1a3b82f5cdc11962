"""Nested artist documents: scan, flattening, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ostinato.sources.schemas import ARTIST_DOCUMENT, RAW_ARTIST, RAW_RELEASE

STRINGS = "array<string>"


def scan_documents(
    spark: SparkSession, folder: str, names: list[str] | None = None, pattern: str = "*_{combined,musicbrainz}.json",
    multi_line: bool = True,
) -> DataFrame:
    """One row per artist document, with ``artist_file`` taken from the file name."""
    docs = (
        spark.read.schema(ARTIST_DOCUMENT)
        .option("multiLine", multi_line)
        .option("pathGlobFilter", pattern)
        .json(folder)
        .select("*", F.col("_metadata.file_name").alias("_file"))
    )
    stem = F.regexp_extract(F.url_decode("_file"), r"^(.*)_(?:combined|musicbrainz)\.json$", 1)
    docs = docs.withColumn("artist_file", stem).drop("_file")
    return docs if names is None else docs.filter(F.col("artist_file").isin(list(names)))


def artists_of(docs: DataFrame) -> DataFrame:
    return docs.select("artist.*")


def works_of(docs: DataFrame) -> DataFrame:
    """One row per work, with the id of its artist."""
    artist = F.coalesce(F.nullif(F.col("artist.musicbrainz_id"), F.lit("")), F.col("artist.artist_id"))
    return docs.select(artist.alias("composer_id"), F.explode("works").alias("w")).select("composer_id", "w.*")


def _names(tag_list: Column) -> Column:
    return F.coalesce(F.transform(tag_list, lambda t: t["name"]), F.array().cast(STRINGS))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def flatten_artists(raw: DataFrame, json: str = "value") -> DataFrame:
    """Raw artist records (JSON text) to typed rows."""
    r = raw.select(F.from_json(json, RAW_ARTIST).alias("r"))
    return r.select(
        F.lit("musicbrainz").alias("source"),
        F.col("r.id").alias("artist_id"),
        F.col("r.name").alias("name"),
        F.col("r.`sort-name`").alias("sort_name"),
        F.col("r.type").alias("type"),
        F.col("r.country").alias("country"),
        F.coalesce(F.col("r.`life-span`"), F.struct(F.lit(None).cast("string").alias("begin"),
                                                    F.lit(None).cast("string").alias("end"))).alias("life_span"),
        _names(F.col("r.`tag-list`")).alias("tags"),
        _text(F.col("r.annotation")).alias("annotation"),
        _text(F.col("r.disambiguation")).alias("disambiguation"),
    )


def flatten_releases(listing: DataFrame, details: DataFrame, key: str = "id") -> DataFrame:
    """Release records to typed rows: the detail record when there is one, else the listing row.

    Both frames hold ``key`` and the record as JSON text in ``value``.
    """
    base = listing.select(F.col(key), F.from_json("value", RAW_RELEASE).alias("b"))
    full = details.select(F.col(key), F.from_json("value", RAW_RELEASE).alias("d"))
    j = base.join(full, key, "left")
    has = F.col("d").isNotNull()

    def pick(field: str) -> Column:
        return F.when(has, F.col(f"d.`{field}`")).otherwise(F.col(f"b.`{field}`"))

    empty = F.array().cast(STRINGS)
    return j.select(
        F.lit("musicbrainz").alias("source"),
        pick("id").alias("release_group_id"),
        pick("title").alias("title"),
        pick("type").alias("primary_type"),
        F.when(has, F.coalesce(F.col("d.`secondary-type-list`"), empty)).alias("secondary_types"),
        pick("first-release-date").alias("first_release_date"),
        F.when(has, _names(F.col("d.`tag-list`"))).otherwise(empty).alias("tags"),
        F.when(has, _text(F.col("d.annotation"))).otherwise(F.lit("")).alias("annotation"),
        has.alias("has_detail"),
    )


PROFILE = ARTIST_DOCUMENT


def validate_profiles(raw: DataFrame, json: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split JSON texts into valid profiles and rejected rows with a reason.

    Needed: the artist's name, each work's title, the extraction time.  A null ``works`` is an
    empty list, absent lists are empty.  A field of the wrong type makes the record corrupt.
    """
    corrupt = StructType([*PROFILE.fields]).add("_corrupt", "string")
    p = raw.withColumn("p", F.from_json(json, corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    untitled = F.exists(F.coalesce(F.col("p.works"), F.array()), lambda w: w["title"].isNull())
    reason = (
        F.when(F.col("p._corrupt").isNotNull() | F.col("p").isNull(), "not a profile")
        .when(F.col("p.artist.name").isNull(), "artist.name is missing")
        .when(untitled, "works.title is missing")
        .when(F.col("p.metadata.extraction_timestamp").isNull(), "metadata.extraction_timestamp is missing")
    )
    p = p.withColumn("reason", reason)
    empty = F.array().cast(STRINGS)
    fill_lists = lambda w: (w.withField("tags", F.coalesce(w["tags"], empty))
                            .withField("secondary_types", F.coalesce(w["secondary_types"], empty)))
    works_type = PROFILE["works"].dataType
    valid = p.filter("reason IS NULL").select(
        F.col("p.artist").withField("musicbrainz_tags", F.coalesce("p.artist.musicbrainz_tags", empty)).alias("artist"),
        F.transform(F.coalesce(F.col("p.works"), F.array().cast(works_type)), fill_lists).alias("works"),
        F.col("p.metadata").withField("sources", F.coalesce("p.metadata.sources", empty)).alias("metadata"),
    )
    return valid, p.filter("reason IS NOT NULL").select(json, "reason")


def export_schema(spark: SparkSession, path: str) -> None:
    """Store the profile schema as one JSON text."""
    spark.createDataFrame([(PROFILE.json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_schema(spark: SparkSession, path: str) -> StructType:
    import json

    return StructType.fromJson(json.loads(spark.read.text(path, wholetext=True).first()[0]))
