"""Correction records and what they teach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.operators.shape import ranked


def tag_changes(old: Column, new: Column) -> tuple[Column, Column]:
    """``(removed, added)`` between two tag arrays."""
    return F.array_except(old, new), F.array_except(new, old)


def capture(works: DataFrame, edits: DataFrame, reviewer: str = "human", at: Column | None = None) -> DataFrame:
    """Correction records from ``(work_id, old_tags, new_tags, reason)`` rows."""
    removed, added = tag_changes(F.col("old_tags"), F.col("new_tags"))
    j = edits.join(works.select("work_id", "title", "composer_id", "work_type", "key", "catalog_number"), "work_id")
    stamp = at if at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return j.select(
        "work_id", "title", "composer_id", "work_type", "key", "catalog_number",
        F.col("old_tags").alias("auto_tags"), F.col("new_tags").alias("corrected_tags"),
        removed.alias("removed"), added.alias("added"), F.coalesce("reason", F.lit("")).alias("reason"),
        F.lit(reviewer).alias("reviewer"), stamp.alias("timestamp"),
    )


def change_counts(corrections: DataFrame, by: str | None = None) -> DataFrame:
    """``(change, [by,] tag, n)``: how often tags were removed and added; a missing ``by`` is ``unknown``."""
    changes = F.explode(F.concat(
        F.transform("removed", lambda t: F.struct(F.lit("removed").alias("change"), t.alias("tag"))),
        F.transform("added", lambda t: F.struct(F.lit("added").alias("change"), t.alias("tag"))),
    )).alias("c")
    keys = [] if by is None else [F.coalesce(F.col(by).cast("string"), F.lit("unknown")).alias(by)]
    rows = corrections.select(*keys, changes).select(*([by] if by else []), "c.*")
    return rows.groupBy("change", *([by] if by else []), "tag").agg(F.count("*").alias("n"))


def top_changes(corrections: DataFrame, n: int = 10) -> DataFrame:
    """The n tags removed most and the n added most."""
    return ranked(change_counts(corrections), ["change"], [F.desc("n"), F.asc("tag")], n)


def patterns(corrections: DataFrame, min_added: int = 3, min_removed: int = 5) -> DataFrame:
    """Rules: a work type's most added tag (often enough), and tags removed too often."""
    added = change_counts(corrections, "work_type").filter("change = 'added' AND work_type <> 'unknown'")
    best = ranked(added, ["work_type"], [F.desc("n"), F.asc("tag")], 1).filter(F.col("n") >= min_added)
    missing = best.select(
        F.lit("work_type_missing_tag").alias("type"), "work_type", "tag", F.col("n").alias("frequency"),
        F.format_string("%s works often need '%s' tag", "work_type", "tag").alias("description"))
    often = top_changes(corrections).filter(f"change = 'removed' AND n >= {int(min_removed)}")
    wrong = often.select(
        F.lit("frequently_incorrect_tag").alias("type"), F.lit(None).cast("string").alias("work_type"), "tag",
        F.col("n").alias("frequency"),
        F.format_string("Tag '%s' is frequently incorrect (removed %d times)", "tag", "n").alias("description"))
    return missing.unionByName(wrong)


def suggestions(corrections: DataFrame, min_uses: int = 5) -> DataFrame:
    """``(slot, suggestion)`` texts from the most removed, the most added and the first three rules."""
    top = top_changes(corrections, 1).filter(F.col("n") >= min_uses)
    text = F.when(
        F.col("change") == "removed",
        F.format_string("Consider updating the prompt to be more careful about using '%s' (removed %d times)", "tag", "n"),
    ).otherwise(F.format_string(
        "The model often misses '%s' - consider adding examples to the prompt (manually added %d times)", "tag", "n"))
    slot = F.when(F.col("change") == "removed", 1).otherwise(2)
    head = top.select(slot.alias("slot"), text.alias("suggestion"))
    # rules come in the order: missing tags by work type, then the incorrect ones; only the former give a text
    rules = patterns(corrections).filter("type = 'work_type_missing_tag'").orderBy("work_type").limit(3)
    tail = rules.select(
        F.lit(3).alias("slot"),
        F.format_string("Add rule: %s works should usually include '%s' tag", "work_type", "tag").alias("suggestion"))
    both = head.unionByName(tail)
    none = both.agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit(9).alias("slot"), F.lit("Not enough corrections yet to generate specific suggestions").alias("suggestion"))
    return both.unionByName(none)


def totals(corrections: DataFrame) -> DataFrame:
    """One row: corrections, tags removed and added in total and on average, first and last time."""
    row = corrections.agg(
        F.count("*").alias("total_corrections"),
        F.coalesce(F.sum(F.size("removed")), F.lit(0)).alias("total_tags_removed"),
        F.coalesce(F.sum(F.size("added")), F.lit(0)).alias("total_tags_added"),
        F.min("timestamp").alias("first_correction"), F.max("timestamp").alias("last_correction"),
    )
    n = F.col("total_corrections")

    def mean(c):
        return F.when(n > 0, F.round(F.col(c) / n, 2)).otherwise(F.lit(0.0))

    return row.select("*", mean("total_tags_removed").alias("avg_tags_removed"), mean("total_tags_added").alias("avg_tags_added"))


def latest(corrections: DataFrame, n: int = 10) -> DataFrame:
    return corrections.orderBy(F.desc("timestamp"), "work_id").limit(n)
