"""Full recommendation rows: scored works with their card and the reason why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.operators import catalog, explain, rerank, semantic, similarity

REASONS = ["composer_id", "work_type", "key", "period", "tags"]
ROW = ["work_id", "title", "composer", "work_type", "key", "period", "similarity_score", "rank", "explanation", "tags"]
NO_TAGS = "array<string>"


def cards(works: DataFrame, composers: DataFrame, tags: DataFrame) -> DataFrame:
    """One card per work, with all its tags; to be stored by work id and read by it."""
    w = catalog.with_composers(works, composers, ["name", "period"]).join(catalog.tags_of_works(tags), "work_id", "left")
    return w.select("work_id", "title", "composer_id", F.coalesce("name", F.lit("Unknown")).alias("composer"), "work_type", "key", "catalog_number", "period",
                    F.coalesce("tags", F.array().cast(NO_TAGS)).alias("tags"))


def rows(scored: DataFrame, all_cards: DataFrame, seed: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``scored (work_id, score, rank)`` as ``ROW``, after the columns ``keep``; with ``seed``, a column of seed ids, each row is explained.

    Only the cards of the works in question meet the join; the first five tags are shown, null if there are none.
    """
    wanted = scored.select(F.col("work_id").alias("_id"))
    if seed:
        wanted = wanted.unionByName(scored.select(F.col(seed).alias("_id")))
    few = all_cards.join(wanted.distinct(), F.col("work_id") == F.col("_id"), "left_semi")
    own = few.select(F.col("work_id").alias("_w"), F.struct(*[c for c in few.columns if c != "work_id"]).alias("_card"))
    j = scored.join(own, F.col("work_id") == F.col("_w"), "left")
    reason = F.lit(None).cast("string")
    if seed:
        of_seed = few.select(F.col("work_id").alias("_s"), F.struct(*REASONS).alias("_seed"))
        j = j.join(of_seed, F.col(seed) == F.col("_s"), "left")
        reason = explain.similarity_sentence(explain.similarity_reasons(F.col("_seed"), F.col("_card")))
    card = F.col("_card")
    first = F.when(F.size(card["tags"]) > 0, F.slice(card["tags"], 1, 5))
    return j.select(*(keep or []), "work_id", *[card[c].alias(c) for c in ("title", "composer", "work_type", "key", "period")],
                    F.col("score").alias("similarity_score"), "rank", reason.alias("explanation"), first.alias("tags"))


def similar(features: DataFrame, all_cards: DataFrame, work_id, n: int = 10, **options) -> DataFrame:
    """Works similar to one work, as full rows."""
    found = similarity.similar_to(features, work_id, n, **options).withColumn("_of", F.lit(work_id))
    return rows(found, all_cards, "_of")


def similar_to_title(features: DataFrame, all_cards: DataFrame, query: str, n: int = 10, **options) -> DataFrame:
    """Works similar to the first work whose title contains the text, as full rows."""
    hit = catalog.search_titles(all_cards, query, 1).select("work_id").collect()
    if not hit:
        raise ValueError(f"No works found matching query: '{query}'")
    return similar(features, all_cards, hit[0][0], n, **options)


def diverse(features: DataFrame, all_cards: DataFrame, seeds: DataFrame | list, n: int = 10, relevance_weight: float = 0.3) -> DataFrame:
    """Greedy diverse lists of many seeds, as full rows after ``seed_id``."""
    found = rerank.diverse(features, seeds, n, relevance_weight).withColumnRenamed("item_id", "work_id")
    return rows(found, all_cards, "seed_id", ["seed_id"])


def browse(works: DataFrame, composers: DataFrame, all_cards: DataFrame, **filters) -> DataFrame:
    """First works under the filters, as full rows without explanation."""
    return rows(catalog.browse(works, composers, **filters).select("work_id", "score", "rank"), all_cards)


def mood_search(queries: DataFrame, descriptions: DataFrame, all_cards: DataFrame, n: int = 10, min_score: float = 0.15, encoder=None, dim: int = 384,
                multiplier: int | None = 3, seed: int = 42) -> DataFrame:
    """The search by mood as one job: ``queries (query)`` to ``(query, work_id, ..., explanation, tags)``.

    Query texts are expanded, encoded with the descriptions ``(work_id, description)`` in one vocabulary, searched with the threshold, drawn by score from
    ``multiplier * n`` candidates (none: the best n), and joined with cards and explanations.
    """
    from ostinato.session import cut

    asked = queries.select("query").distinct()
    texts = descriptions.select(F.concat(F.lit("w"), "work_id").alias("id"), F.col("description").alias("text")).unionByName(
        asked.select(F.concat(F.lit("q"), "query").alias("id"), semantic.expand_query(F.col("query")).alias("text")))
    texts = cut(texts, "texts")
    vectors = cut(semantic.embed(texts, "id", "text", encoder, dim=dim), "vectors")
    id_type = descriptions.schema["work_id"].dataType
    own = F.expr("substr(id, 2)")
    q = vectors.filter("id LIKE 'q%'").select(own.alias("query"), "embedding")
    w = vectors.filter("id LIKE 'w%'").select(own.cast(id_type).alias("work_id"), "embedding")
    found = semantic.search(q, w, n * (multiplier or 1), min_score, "query", "work_id")
    if multiplier:
        found = rerank.sample_by_score(found.select("query", "work_id", "score"), n, "query", "work_id", multiplier, seed)
    full = rows(found, all_cards, keep=["query"]).drop("explanation")
    return explain.explain_results(full).select("query", *ROW)
