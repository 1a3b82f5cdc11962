"""Lookup, search, filters and decoration of works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.functions.fixed_values import POPULAR_QUERIES
from ostinato.operators.shape import first_per_key, ranked

COMPOSER_FIELDS = ["name", "period", "country", "birth_year", "death_year"]


def work_by_id(works: DataFrame, work_id) -> DataFrame:
    return works.filter(F.col("work_id") == F.lit(work_id))


def _contains(c: Column, text: str, regex: bool) -> Column:
    return c.rlike("(?iU)" + text) if regex else F.lower(c).contains(text.lower())


def search_titles(works: DataFrame, query: str, limit: int = 10, regex: bool = False, order: str = "work_id") -> DataFrame:
    """Works whose title contains the text, ignoring case; the first ``limit`` by order key."""
    return works.filter(_contains(F.col("title"), query, regex)).orderBy(order).limit(limit)


def with_composers(works: DataFrame, composers: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Works with their composer's fields (those the table has); unmatched works stay."""
    wanted = [c for c in (fields or COMPOSER_FIELDS) if c in composers.columns]
    return works.join(composers.select("composer_id", *wanted), "composer_id", "left")


def filter_works(
    works: DataFrame, composers: DataFrame, composer_id=None, work_type: str | None = None, key: str | None = None,
    period: str | None = None,
) -> DataFrame:
    """Works that meet every given facet; the composer table is read only for ``period``."""
    for column, value in (("composer_id", composer_id), ("work_type", work_type), ("key", key)):
        if value is not None:
            works = works.filter(F.col(column) == F.lit(value))
    if period is not None:
        works = works.join(composers.filter(F.col("period") == period).select("composer_id", "period"), "composer_id")
    return works


def browse(
    works: DataFrame, composers: DataFrame, composer: str | None = None, period: str | None = None,
    work_type: str | None = None, key: str | None = None, n: int = 10, regex: bool = False, order: str = "work_id",
) -> DataFrame:
    """First n works under the filters with score 1.0 and rank; errors when nobody or nothing matches."""
    composer_id = None
    if composer is not None:
        first = composers.filter(_contains(F.col("name"), composer, regex)).orderBy("composer_id").limit(1).collect()
        if not first:
            raise ValueError(f"Composer not found: '{composer}'")
        composer_id = first[0]["composer_id"]
    rows = filter_works(works, composers, composer_id, work_type, key, period).orderBy(order).limit(n)
    if rows.isEmpty():
        raise ValueError("No works match the specified filters")
    return ranked(rows.withColumn("score", F.lit(1.0)), [], [F.col(order)])


def fill_for_features(df: DataFrame, text: str = "unknown") -> DataFrame:
    known = {c: text for c in ("name", "period", "country", "work_type", "key") if c in df.columns}
    return df.fillna({**known, **({"catalog_number": ""} if "catalog_number" in df.columns else {})})


def split_ratings(feedback: DataFrame, rating: str = "rating") -> tuple[DataFrame, DataFrame]:
    """Accepted rows (rating -1 or 1) and rejected ones; a null rating is rejected."""
    ok = F.coalesce(F.col(rating).isin(-1, 1), F.lit(False))
    return feedback.filter(ok), feedback.filter(~ok)


def tags_of_works(tags: DataFrame, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """``(work_id, tags)`` in order.

    With a limit only the first rows of each work reach the list.  Without one, equal tags are
    counted before the shuffle and repeated inside the list, so a long run of copies stays small.
    """
    order = order or ["tag", *([] if "source" not in tags.columns else ["source"])]
    if limit is not None:
        rows = ranked(tags, ["work_id"], [F.col(c) for c in order], limit, "_r")
        lists = rows.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("_r", "tag"))).alias("l"))
        return lists.select("work_id", F.transform("l", lambda x: x["tag"]).alias("tags"))
    if order[0] == "tag":
        runs = tags.groupBy("work_id", "tag").agg(F.count("*").cast("int").alias("n"))
        lists = runs.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("tag", "n"))).alias("l"))
        return lists.select("work_id", F.flatten(F.transform("l", lambda x: F.array_repeat(x["tag"], x["n"]))).alias("tags"))
    lists = tags.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct(*order, "tag"))).alias("l"))
    return lists.select("work_id", F.transform("l", lambda x: x["tag"]).alias("tags"))


def decorate(scored: DataFrame, works: DataFrame, composers: DataFrame, tags: DataFrame) -> DataFrame:
    """Scored ``work_id`` rows with title, composer, type, key, period and the first five tags."""
    keep = [c for c in scored.columns if c != "work_id"]
    ids = scored.select("work_id").distinct()
    w = works.join(ids, "work_id", "left_semi")
    w = with_composers(w, composers, ["name", "period"])
    first_tags = tags_of_works(tags.join(ids, "work_id", "left_semi"), limit=5)
    return (
        scored.join(w, "work_id", "left").join(first_tags, "work_id", "left")
        .select("work_id", "title", F.coalesce("name", F.lit("Unknown")).alias("composer"), "work_type", "key", "period",
                *keep, "tags")
    )


def work_cards(works: DataFrame, composers: DataFrame, tags: DataFrame) -> DataFrame:
    """One card per work: composer name (``Unknown`` when none), facts, all tags."""
    w = with_composers(works, composers, ["name", "period"]).join(tags_of_works(tags), "work_id", "left")
    return w.select(
        "work_id", F.col("title"), F.coalesce("name", F.lit("Unknown")).alias("composer"), "work_type", "key",
        "catalog_number", "period", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )


def share_cards(works: DataFrame, composers: DataFrame) -> DataFrame:
    """Projection for share pages, with defaults for absent titles and composers."""
    w = with_composers(works, composers, ["name", "period"])
    return w.select(
        "work_id", F.coalesce("title", F.lit("Untitled")).alias("title"),
        F.coalesce("name", F.lit("Unknown")).alias("composer"), "work_type", "period", "key",
        F.lit(None).cast("string").alias("instrumentation"),
    )


def popular_cards(works: DataFrame, n: int = 10, queries: list[str] | None = None, order: str = "work_id") -> DataFrame:
    """The first n works for each popular query, with the cache key of the pair."""
    q = F.explode(F.array(*[F.lit(x) for x in (queries or POPULAR_QUERIES)]))
    return works.orderBy(order).limit(n).select("work_id", "title", q.alias("query")).withColumn(
        "card_key", F.md5(F.concat_ws("-", F.col("work_id").cast("string"), "query")))


def first_per_type(works: DataFrame, order: str = "work_id") -> DataFrame:
    return first_per_key(works.filter("work_type IS NOT NULL"), ["work_type"], [F.col(order)])
