"""Queries: the end-to-end jobs and the tagger plug-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.operators import tags as tg
from ostinato.plans.etl import run_etl
from ostinato.plans.queries_tables import artist_documents
from ostinato.plans.queries_tags import ENHANCE_SQL, UNTAGGED_SQL, _rule_tags_sql
from ostinato.plans.registry import query
from ostinato.plans.tagging import run_tagging
from ostinato.plans.views import Tables
from ostinato.session import fresh_path


@query("g6_tag_untagged", "works tags", "SELECT work_id, tag, source, confidence FROM tags UNION ALL SELECT work_id, tag, 'auto-tagger', 1.0 FROM made", _rule_tags_sql(UNTAGGED_SQL))
def _(t: Tables):
    at = F.lit("2024-01-01").cast("timestamp")
    run = run_tagging(t.works, t.composers, t.tags, created_at=at, out=fresh_path(t.spark, "tagged"), max_cost_usd=1e9)
    return run.tags.drop("created_at")


@query("g6_enhance", "works tags", "SELECT work_id, tag, 'auto-tagger' AS source, 1.0::DOUBLE AS confidence FROM made", _rule_tags_sql(ENHANCE_SQL))
def _(t: Tables):
    at = F.lit("2024-01-01").cast("timestamp")
    return run_tagging(t.works, t.composers, t.tags, mode="enhance", created_at=at, max_cost_usd=1e9).new_tags.drop("created_at")


def first_words_tagger(texts):
    """Tagger plug-in: a tag by the mode of the key in the context text."""
    return [["dark", "not-a-tag"] if " minor" in x else ["bright"] for x in texts]


@query("x2_tagger_plugin", "works", "SELECT work_id, CASE WHEN contains(title, ' minor') THEN 'dark' ELSE 'bright' END AS tags, NULL AS error FROM works")
def _(t: Tables):
    return tg.custom_tags(tg.tagging_context(t.works, t.composers), first_words_tagger).withColumn("tags", F.array_join("tags", "|"))


@query("g7_etl", "works composers", """, w AS (SELECT * FROM works WHERE composer_id IN (SELECT composer_id FROM composers))
SELECT 'works' AS "table", CAST(count(*) AS BIGINT) AS n FROM w UNION ALL SELECT 'work_tags', sum(CASE WHEN work_type IS NULL THEN 1 ELSE 2 END) FROM w
 UNION ALL SELECT 'composers', (SELECT count(*) FROM (SELECT DISTINCT composer_id, coalesce(work_type, ''), key FROM w)) UNION ALL SELECT 'errors', 0""")
def _(t: Tables):
    src = fresh_path(t.spark, "documents")
    artist_documents(t).write.json(src)
    r = run_etl(t.spark, src, fresh_path(t.spark, "etl"), pattern="*.json", multi_line=False)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table"), "n") for n, df in r.tables.items()]
    errors = r.metrics.select(F.lit("errors").alias("table"), F.size("errors").cast("bigint").alias("n"))
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(errors)
