"""End-to-end tagging job: select, estimate, gate, tag, merge reviews, union, write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ostinato.operators import tags as tg
from ostinato.session import cut
from ostinato.sources.sinks import write_csv


class BudgetExceeded(RuntimeError):
    pass


@dataclass
class TaggingRun:
    tags: DataFrame
    new_tags: DataFrame
    processed: DataFrame
    estimate: dict


def run_tagging(
    works: DataFrame, composers: DataFrame, existing: DataFrame, mode: str = "untagged", tagger=None, decisions: DataFrame | None = None,
    processed: DataFrame | None = None, id_list: str | None = None, max_works: int | None = None, max_cost_usd: float = 5.0,
    created_at: Column | None = None, out: str | None = None,
) -> TaggingRun:
    """Tag the chosen works and merge the result with the existing tags.

    ``mode``: ``untagged`` works, ``enhance`` (source tags but no tagger tags), or ``retag`` (a comma
    list).  ``decisions`` are applied to the new tags; without them all are approved.  A cost above
    ``max_cost_usd`` stops the run before any tagging.  The new tags are stored once, so that the
    tagger runs once per work.
    """
    if mode == "untagged":
        chosen = tg.untagged_works(works, existing, max_works)
    elif mode == "enhance":
        chosen = tg.works_to_enhance(works, existing)
        chosen = chosen if max_works is None else chosen.orderBy("work_id").limit(max_works)
    elif mode == "retag":
        chosen = tg.works_by_list(works, id_list or "")
    else:
        raise ValueError(f"unknown mode: {mode}")
    pending = tg.pending_works(chosen, processed)
    estimate = tg.cost_estimate(pending, max_cost_usd=max_cost_usd).first().asDict()
    if not estimate["within_budget"]:
        raise BudgetExceeded(f"estimated cost {estimate['estimated_cost_usd']} exceeds {max_cost_usd}")
    results = tg.rule_tags(pending) if tagger is None else tg.custom_tags(tg.tagging_context(pending, composers), tagger)
    results = cut(results, "tag-results")
    new = tg.tag_rows(results, created_at)
    done = tg.newly_processed(results)
    if processed is not None:
        done = processed.select("work_id").unionByName(done)
    if decisions is not None:
        new = tg.merge_review(new, decisions)
    final = tg.union_tags(existing, new)
    if out is not None:
        final.write.mode("overwrite").parquet(f"{out}/work_tags_enhanced.parquet")
        write_csv(final, f"{out}/work_tags_enhanced.csv")
    return TaggingRun(final, new, done, estimate)
