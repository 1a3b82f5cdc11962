"""Tag associations: selection, playful titles, review merges, tagging jobs, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.functions.fixed_values import (
    INPUT_TOKENS_PER_WORK,
    INPUT_USD_PER_MILLION,
    OUTPUT_TOKENS_PER_WORK,
    OUTPUT_USD_PER_MILLION,
    PLAYFUL_PATTERNS,
    PLAYFUL_TAGS,
    TAXONOMY,
)
from ostinato.functions.titles import plain_key
from ostinato.operators.rerank import uniform
from ostinato.operators.shape import one_row, pct

AUTO, SOURCE, HUMAN = "auto-tagger", "musicbrainz", "human-review"
USD_PER_WORK = (INPUT_TOKENS_PER_WORK * INPUT_USD_PER_MILLION + OUTPUT_TOKENS_PER_WORK * OUTPUT_USD_PER_MILLION) / 1e6
ALL_TAGS = list(dict.fromkeys(t for ts in TAXONOMY.values() for t in ts))


# --- selection ---------------------------------------------------------------------------------

def untagged_works(works: DataFrame, tags: DataFrame, limit: int | None = None, order: str = "work_id") -> DataFrame:
    out = works.join(tags.select("work_id"), "work_id", "left_anti")
    return out if limit is None else out.orderBy(order).limit(limit)


def works_to_enhance(works: DataFrame, tags: DataFrame, have: str = SOURCE, lack: str = AUTO) -> DataFrame:
    """Works with tags of one source and none of the other."""
    ids = tags.groupBy("work_id").agg(
        F.bool_or(F.col("source") == have).alias("a"), F.bool_or(F.col("source") == lack).alias("b")
    ).filter(F.col("a") & ~F.coalesce("b", F.lit(False))).select("work_id")
    return works.join(ids, "work_id", "left_semi")


def works_by_list(works: DataFrame, comma_list: str) -> DataFrame:
    """Works named in a comma-separated id list."""
    ids = [i.strip() for i in comma_list.split(",") if i.strip()]
    return works.filter(F.col("work_id").cast("string").isin(ids))


def playful_candidates(works: DataFrame, tags: DataFrame) -> DataFrame:
    """Works whose title has a playful pattern, with the suggested tags they lack."""
    t = F.lower("title")
    names = list(PLAYFUL_PATTERNS)
    pattern = F.coalesce(*[F.when(t.contains(p), F.lit(p)) for p in names])
    wanted = F.coalesce(*[F.when(t.contains(p), F.array(*map(F.lit, ts))) for p, ts in PLAYFUL_PATTERNS.items()])
    hits = works.filter(pattern.isNotNull()).select("work_id", "title", pattern.alias("pattern"), wanted.alias("wanted"))
    relevant = sorted({x for ts in PLAYFUL_PATTERNS.values() for x in ts} | set(PLAYFUL_TAGS))
    present = (
        tags.filter(F.col("tag").isin(relevant)).join(hits.select("work_id"), "work_id", "left_semi")
        .groupBy("work_id").agg(F.collect_set("tag").alias("present"))  # at most the suggested words
    )
    none = F.array().cast("array<string>")
    out = hits.join(present, "work_id", "left").select(
        "work_id", "title", "pattern",
        F.arrays_overlap(F.coalesce("present", none), F.array(*map(F.lit, PLAYFUL_TAGS))).alias("has_playful"),
        F.array_except("wanted", F.coalesce("present", none)).alias("suggested"),
    )
    return out.filter(~F.col("has_playful") | (F.size("suggested") > 0))


# --- unions and merges ----------------------------------------------------------------------------

def union_tags(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new, allowMissingColumns=True)


def id_sets(tags: DataFrame, a: str = SOURCE, b: str = AUTO) -> DataFrame:
    """One row: distinct works of a without b, of both, of b without a."""
    per = tags.groupBy("work_id").agg(
        F.bool_or(F.col("source") == a).alias("a"), F.bool_or(F.col("source") == b).alias("b"))
    return per.agg(
        F.count_if(F.col("a") & ~F.col("b")).alias("only_first"),
        F.count_if(F.col("a") & F.col("b")).alias("both"),
        F.count_if(~F.col("a") & F.col("b")).alias("only_second"),
    )


def id_difference(tags: DataFrame, a: str = SOURCE, b: str = AUTO) -> DataFrame:
    return tags.filter(F.col("source") == a).select("work_id").subtract(tags.filter(F.col("source") == b).select("work_id"))


def id_intersection(tags: DataFrame, a: str = SOURCE, b: str = AUTO) -> DataFrame:
    return tags.filter(F.col("source") == a).select("work_id").intersect(tags.filter(F.col("source") == b).select("work_id"))


def merge_review(new_tags: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply decisions ``(work_id, decision, new_tags)`` to freshly made tags.

    Rejected works vanish; corrected works keep the tags that survive and gain the added ones as
    ``human-review`` with confidence 1; all others pass.
    """
    corrected = decisions.filter("decision = 'corrected'").select("work_id", F.explode("new_tags").alias("tag")).distinct()
    settled = decisions.filter("decision IN ('rejected', 'corrected')").select("work_id")
    passed = new_tags.join(settled, "work_id", "left_anti")
    kept = new_tags.join(corrected, ["work_id", "tag"], "left_semi")
    known = new_tags.select("work_id", "tag").distinct()
    added = (
        corrected.join(new_tags.select("work_id"), "work_id", "left_semi").join(known, ["work_id", "tag"], "left_anti")
        .select("work_id", "tag", F.lit(HUMAN).alias("source"), F.lit(1.0).alias("confidence"))
    )
    return passed.unionByName(kept).unionByName(added, allowMissingColumns=True)


def review_selection(tags: DataFrame, mode: str = "quick", sample_size: int = 10, threshold: float = 0.7, seed: int = 42) -> DataFrame:
    """Works to review: a random sample, those with a low-confidence tag, or all."""
    if mode == "confidence":
        return tags.filter(F.col("confidence") < threshold).select("work_id").distinct()
    ids = tags.select("work_id").distinct()
    if mode == "quick" and sample_size:
        return ids.orderBy(uniform("work_id", seed=seed), "work_id").limit(sample_size)
    return ids


def valid_tags(tags: Column) -> Column:
    """Members of the taxonomy, in order."""
    members = F.array(*map(F.lit, ALL_TAGS))
    return F.filter(tags, lambda t: F.array_contains(members, t))


def apply_edits(tag_lists: DataFrame, edits: DataFrame) -> DataFrame:
    """Edit tag lists ``(work_id, tags)`` by ``(work_id, remove, add)``: drop the removed, append the valid added."""
    j = tag_lists.join(edits, "work_id", "left")
    none = F.array().cast("array<string>")
    kept = F.filter("tags", lambda t: ~F.array_contains(F.coalesce("remove", none), t))
    return j.select("work_id", "tags", F.concat(kept, F.coalesce(valid_tags(F.col("add")), none)).alias("new_tags"))


def split_list(text: Column) -> Column:
    return F.transform(F.split(text, ","), F.trim)


# --- figures ---------------------------------------------------------------------------------------

def origin_stats(tags: DataFrame, works: DataFrame) -> DataFrame:
    """One row: works by tag origin, untagged works, shares, entry counts."""
    per = tags.groupBy("work_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("source") == SOURCE).alias("n_src"),
        F.count_if(F.col("source") == AUTO).alias("n_auto"),
    )
    t = per.agg(
        F.count("*").alias("any_tags"), F.count_if(F.col("n_src") > 0).alias("source_works"), F.count_if(F.col("n_auto") > 0).alias("auto_works"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.coalesce(F.sum("n_src"), F.lit(0)).alias("source_entries"),
        F.coalesce(F.sum("n_auto"), F.lit(0)).alias("auto_entries"),
    )
    row = one_row(t, works.agg(F.count("*").alias("total_works")))
    row = row.withColumn("untagged", F.col("total_works") - F.col("any_tags"))
    shares = ("source_works", "auto_works", "any_tags", "untagged")
    return row.select("*", *[pct(F.col(c), F.col("total_works"), 1).alias(f"{c}_pct") for c in shares])


def review_outcome(decisions: DataFrame, mode: str = "quick", threshold: float = 0.8) -> DataFrame:
    """One row: decisions by kind, approval rate, and whether the rest may be approved unseen."""
    row = decisions.agg(*[F.count_if(F.col("decision") == d).alias(d) for d in ("approved", "corrected", "rejected", "skipped")])
    row = row.withColumn("total_reviewed", F.col("approved") + F.col("corrected") + F.col("rejected"))
    rate = F.when(F.col("total_reviewed") > 0, (F.col("approved") + F.col("corrected")) / F.col("total_reviewed")).otherwise(F.lit(0.0))
    row = row.withColumn("approval_rate", rate)
    auto = F.lit(mode == "quick") & (F.col("approval_rate") >= threshold) & (F.col("skipped") == 0)
    return row.withColumn("auto_approve", auto)


def approve_all(ids: DataFrame) -> DataFrame:
    return ids.select("work_id").distinct().withColumn("decision", F.lit("approved"))


def run_stats(results: DataFrame) -> DataFrame:
    """Figures of a tagging run over ``(work_id, tags, error, input_tokens, output_tokens)``."""
    ok = F.col("error").isNull() & (F.size("tags") > 0)
    row = results.agg(
        F.count("*").alias("attempted"), F.count_if(ok).alias("successful"),
        F.count_if(F.col("error").isNotNull()).alias("failed_requests"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )
    n = F.col("attempted")
    in_usd, out_usd = F.col("input_tokens") / 1e6 * INPUT_USD_PER_MILLION, F.col("output_tokens") / 1e6 * OUTPUT_USD_PER_MILLION
    return row.select(
        "*", (n - F.col("successful")).alias("failed"),
        F.when(n > 0, F.col("successful") / n).otherwise(F.lit(0.0)).alias("success_rate"),
        F.when(n > 0, (n - F.col("failed_requests")) / n).otherwise(F.lit(0.0)).alias("request_success_rate"),
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.round(in_usd, 3).alias("input_cost_usd"), F.round(out_usd, 3).alias("output_cost_usd"),
        F.round(in_usd + out_usd, 3).alias("total_cost_usd"),
    )


def cost_estimate(pending: DataFrame, delay_seconds: float = 1.0, max_cost_usd: float = 5.0) -> DataFrame:
    """One row: tokens, dollars and minutes for the pending works, and whether they fit the budget."""
    row = pending.agg(F.count("*").alias("total_works"))
    n = F.col("total_works")
    return row.select(
        "total_works",
        (n * (INPUT_TOKENS_PER_WORK + OUTPUT_TOKENS_PER_WORK)).alias("estimated_tokens"),
        F.round(n * USD_PER_WORK, 3).alias("estimated_cost_usd"),
        F.round(n * delay_seconds / 60, 1).alias("estimated_time_minutes"),
        (n * USD_PER_WORK <= max_cost_usd).alias("within_budget"),
        F.lit(float(max_cost_usd)).alias("max_budget_usd"),
    )


# --- responses and lookups -----------------------------------------------------------------------------

def parse_responses(responses: DataFrame, column: str = "response", max_tags: int = 10, min_tags: int = 5) -> DataFrame:
    """Model answers to tag lists: code fences off, JSON read, taxonomy members kept, at most ``max_tags``.

    An answer that is no JSON object becomes an error row.
    """
    text = F.trim(column)
    text = F.regexp_replace(text, r"^```json", "")
    text = F.regexp_replace(text, r"^```", "")
    text = F.trim(F.regexp_replace(text, r"```\s*$", ""))
    # trim() keeps line breaks, JSON readers do not mind them
    parsed = F.from_json(text, "tags array<string>, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = responses.withColumn("_p", parsed)
    bad = F.col("_p").isNull() | F.col("_p._bad").isNotNull()
    none = F.array().cast("array<string>")
    tags = F.when(bad, none).otherwise(F.slice(valid_tags(F.coalesce(F.col("_p.tags"), none)), 1, max_tags))
    return out.select(
        *responses.columns, tags.alias("tags"), F.when(bad, F.lit("JSON parse error")).alias("error"),
        (~bad & (F.size(valid_tags(F.coalesce(F.col("_p.tags"), none))) < min_tags)).alias("too_few"),
    )


def tag_category(tag: Column) -> Column:
    """First taxonomy category that lists the tag, else ``unknown``."""
    chain = [F.when(tag.isin(tags), F.lit(c)) for c, tags in TAXONOMY.items()]
    return F.coalesce(*chain, F.lit("unknown"))


def tagging_context(works: DataFrame, composers: DataFrame) -> DataFrame:
    """``(work_id, context)``: the facts of a work as lines of text, absent ones left out."""
    j = works.join(composers.select("composer_id", "name", "period", "birth_year", "death_year"), "composer_id", "left")

    def full(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(""))

    years = F.when(
        F.col("birth_year").isNotNull() & (F.col("birth_year") != 0),
        F.when(F.col("death_year").isNotNull() & (F.col("death_year") != 0),
               F.concat(F.lit(", "), F.col("birth_year"), F.lit("-"), F.col("death_year")))
        .otherwise(F.concat(F.lit(", b. "), F.col("birth_year"))),
    ).otherwise(F.lit(""))
    in_brackets = F.when(full("period").isNotNull(), F.concat(F.lit(" ("), F.col("period"), years, F.lit(")"))).otherwise(F.lit(""))
    lines = [
        F.concat(F.lit("Title: "), F.coalesce("title", F.lit("Unknown Title"))),
        F.concat(F.lit("Composer: "), F.col("name"), in_brackets),
        F.concat(F.lit("Type: "), full("work_type")),
        F.concat(F.lit("Key: "), full("key")),
        F.concat(F.lit("Catalog: "), full("catalog_number")),
    ]
    return j.select("work_id", F.concat_ws("\n", *lines).alias("context"))


# --- tagging job -------------------------------------------------------------------------------------------

def rule_tags(works: DataFrame) -> DataFrame:
    """The built-in tagger: playful patterns, form hints and key moods that are taxonomy members."""
    from ostinato.operators.semantic import key_moods

    t = F.lower(F.coalesce("title", F.lit("")))
    none = F.array().cast("array<string>")
    playful = [F.when(t.contains(p), F.array(*map(F.lit, ts))).otherwise(none) for p, ts in PLAYFUL_PATTERNS.items()]
    forms = [
        F.when(t.contains("galopade"), F.array(F.lit("playful"), F.lit("elegant"))).otherwise(none),
        F.when(t.contains("waltz") & F.coalesce(F.lower("key").contains("major"), F.lit(False)),
               F.array(F.lit("cheerful"), F.lit("lighthearted"))).otherwise(none),
    ]
    moods = F.split(key_moods(plain_key("key")), " ")
    found = F.array_distinct(F.concat(*playful, *forms, F.coalesce(moods, none)))
    return works.select("work_id", F.slice(valid_tags(found), 1, 10).alias("tags"), F.lit(None).cast("string").alias("error"))


def custom_tags(contexts: DataFrame, tagger) -> DataFrame:
    """Run a tagger plug-in ``list[str] -> list[list[str]]`` over context texts, batch by batch.

    A failing batch is retried row by row; a failing row becomes an error row.
    """
    id_type = contexts.schema["work_id"].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            texts = pdf["context"].tolist()
            tags, errors = [], []
            try:
                tags, errors = list(tagger(texts)), [None] * len(texts)
            except Exception:  # noqa: BLE001
                for x in texts:
                    try:
                        tags.append(list(tagger([x]))[0])
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001
                        tags.append([])
                        errors.append(str(e))
            yield pd.DataFrame({"work_id": pdf["work_id"], "tags": tags, "error": errors})

    raw = contexts.select("work_id", "context").mapInPandas(run, f"work_id {id_type}, tags array<string>, error string")
    return raw.withColumn("tags", F.slice(valid_tags(F.coalesce("tags", F.array().cast("array<string>"))), 1, 10))


def tag_rows(results: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Tagger results to association rows; failed and empty works give none and so stay pending."""
    return results.filter("error IS NULL").select(
        "work_id", F.explode("tags").alias("tag"), F.lit(AUTO).alias("source"), F.lit(1.0).alias("confidence"),
        (created_at if created_at is not None else F.current_timestamp()).alias("created_at"),
    )


def pending_works(works: DataFrame, processed: DataFrame | None, batch_size: int | None = None, order: str = "work_id") -> DataFrame:
    """Batch cap first (None = all, <= 0 = 50), then the works not processed yet."""
    if batch_size is not None:
        works = works.orderBy(order).limit(batch_size if batch_size > 0 else 50)
    return works if processed is None else works.join(processed.select("work_id"), "work_id", "left_anti")


def newly_processed(results: DataFrame) -> DataFrame:
    return results.filter(F.col("error").isNull() & (F.size("tags") > 0)).select("work_id")


def progress(works: DataFrame, processed: DataFrame) -> DataFrame:
    """One row: all, processed, remaining works, share done."""
    done = works.select("work_id").join(processed.select("work_id"), "work_id", "left_semi").agg(F.count("*").alias("processed"))
    row = one_row(works.agg(F.count("*").alias("total")), done)
    return row.select("total", "processed", (F.col("total") - F.col("processed")).alias("remaining"),
                      pct(F.col("processed"), F.col("total")).alias("pct_done"))


def unite(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
