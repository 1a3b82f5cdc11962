"""Queries: tag selection, merges, metrics, corrections, tagging (J4-J16, U, A7-A20, F13-F15, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.functions.fixed_values import PLAYFUL_PATTERNS, PLAYFUL_TAGS, TAXONOMY
from ostinato.operators import corrections as corr
from ostinato.operators import similarity
from ostinato.operators import tag_metrics as tm
from ostinato.operators import tags as tg
from ostinato.operators.catalog import tags_of_works
from ostinato.plans.common import CORRECTIONS_SQL, DECISIONS_SQL, OLD_NEW_SQL, decisions, derived_corrections, draw_sql, edits
from ostinato.plans.registry import query
from ostinato.plans.views import Tables

CORR = OLD_NEW_SQL | CORRECTIONS_SQL
B = "CAST(count(*) AS BIGINT)"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


# --- joins and sets ------------------------------------------------------------------------------------

@query("j4_tags_with_group", "works tags", "SELECT t.work_id, tag, work_type FROM tags t LEFT JOIN works w ON t.work_id = w.work_id")
def _(t: Tables):
    return tm.tags_with_group(t.tags, t.works, "work_type").select("work_id", "tag", "work_type")


@query("j7_untagged_works", "works tags", "SELECT work_id, title FROM works WHERE work_id NOT IN (SELECT work_id FROM tags)")
def _(t: Tables):
    return tg.untagged_works(t.works, t.tags).select("work_id", "title")


@query("j8_works_to_enhance", "works tags", """SELECT work_id, title FROM works WHERE work_id IN (SELECT work_id FROM tags WHERE source = 'musicbrainz')
 AND work_id NOT IN (SELECT work_id FROM tags WHERE source = 'auto-tagger')""")
def _(t: Tables):
    return tg.works_to_enhance(t.works, t.tags).select("work_id", "title")


@query("j9_works_by_list", "works", "SELECT work_id, title FROM works WHERE work_id IN (3, 14, 15, 926)")
def _(t: Tables):
    return tg.works_by_list(t.works, "3, 14,15 , 926").select("work_id", "title")


PAIRS = """SELECT a.grp, CAST(count(*) AS BIGINT) AS pairs, sum(i / (a.n + b.n - i)) AS s FROM
 (SELECT grp, work_id, list(DISTINCT tag) AS tags, count(DISTINCT tag) AS n FROM gt GROUP BY 1, 2) a
 JOIN (SELECT grp, work_id, list(DISTINCT tag) AS tags, count(DISTINCT tag) AS n FROM gt GROUP BY 1, 2) b ON a.grp = b.grp AND a.work_id < b.work_id,
 LATERAL (SELECT len(list_intersect(a.tags, b.tags)) AS i) GROUP BY a.grp"""


@query("j13_group_pairs", "works tags", "SELECT grp, pairs, round(s, 6) AS sum_similarity FROM p", {
    "gt": "SELECT CAST(composer_id AS VARCHAR) AS grp, t.work_id, tag FROM tags t JOIN works w ON t.work_id = w.work_id WHERE composer_id IS NOT NULL", "p": PAIRS})
def _(t: Tables):
    return tm.group_similarity(t.tags, t.works, "composer_id").select("grp", "pairs", F.round("sum_similarity", 6).alias("sum_similarity"))


@query("a9_group_consistency", "works tags", "SELECT split_part(grp, ':', 1) AS grouping, split_part(grp, ':', 2) AS grp, CAST((1 + sqrt(1 + 8 * pairs)) / 2 AS BIGINT) AS works_count, round(s / pairs, 3) AS avg_similarity FROM p", {
    "gt": """SELECT concat('work_type:', work_type) AS grp, t.work_id, tag FROM tags t JOIN works w ON t.work_id = w.work_id WHERE work_type IS NOT NULL
 UNION ALL SELECT concat('composer_id:', composer_id), t.work_id, tag FROM tags t JOIN works w ON t.work_id = w.work_id WHERE composer_id IS NOT NULL
 UNION ALL SELECT concat('key:', key), t.work_id, tag FROM tags t JOIN works w ON t.work_id = w.work_id WHERE key IS NOT NULL""", "p": PAIRS})
def _(t: Tables):
    return tm.consistency(t.tags, t.works, ["work_type", "composer_id", "key"])


_pattern_case = "CASE " + " ".join(f"WHEN contains(lower(title), '{p}') THEN '{p}'" for p in PLAYFUL_PATTERNS) + " END"
_wanted_case = "CASE " + " ".join(f"WHEN contains(lower(title), '{p}') THEN {list(ts)}" for p, ts in PLAYFUL_PATTERNS.items()) + " END"


@query("j16_playful_candidates", "works tags", f"""SELECT work_id, title, pattern, has_playful, array_to_string(suggested, '|') AS suggested FROM
 (SELECT w.work_id, title, pattern, list_has_any(cur, {list(PLAYFUL_TAGS)}) AS has_playful, list_filter(wanted, lambda x: NOT list_contains(cur, x)) AS suggested FROM
  (SELECT work_id, title, {_pattern_case} AS pattern, {_wanted_case} AS wanted FROM works) w
  LEFT JOIN (SELECT work_id, list(tag) AS c FROM tags GROUP BY 1) g ON g.work_id = w.work_id, LATERAL (SELECT coalesce(c, CAST([] AS VARCHAR[])) AS cur) WHERE pattern IS NOT NULL)
 WHERE NOT has_playful OR len(suggested) > 0""")
def _(t: Tables):
    return tg.playful_candidates(t.works, t.tags).withColumn("suggested", F.array_join("suggested", "|"))


@query("u1_union_tags", "tags", "SELECT work_id, tag, source, confidence FROM tags UNION ALL SELECT work_id, lower(tag), 'musicbrainz', NULL FROM tags WHERE source = 'musicbrainz'")
def _(t: Tables):
    plain = t.tags.filter("source = 'musicbrainz'").select("work_id", F.lower("tag").alias("tag"), "source")
    return tg.union_tags(t.tags, plain)


@query("u2_id_sets", "tags", """SELECT CAST(count(*) FILTER (a AND NOT b) AS BIGINT) AS only_first, CAST(count(*) FILTER (a AND b) AS BIGINT) AS "both",
 CAST(count(*) FILTER (b AND NOT a) AS BIGINT) AS only_second FROM (SELECT work_id, bool_or(source = 'musicbrainz') AS a, bool_or(source = 'auto-tagger') AS b FROM tags GROUP BY 1)""")
def _(t: Tables):
    return tg.id_sets(t.tags)


@query("u2_id_difference", "tags", "SELECT work_id FROM tags WHERE source = 'musicbrainz' EXCEPT SELECT work_id FROM tags WHERE source = 'auto-tagger'")
def _(t: Tables):
    return tg.id_difference(t.tags)


@query("u2_id_intersection", "tags", "SELECT work_id FROM tags WHERE source = 'musicbrainz' INTERSECT SELECT work_id FROM tags WHERE source = 'auto-tagger'")
def _(t: Tables):
    return tg.id_intersection(t.tags)


@query("u3_tag_changes", "works tags", "SELECT work_id, array_to_string(removed, '|') AS removed, array_to_string(added, '|') AS added FROM corrections", CORR)
def _(t: Tables):
    return derived_corrections(t).select(
        "work_id", F.array_join(F.array_sort("removed"), "|").alias("removed"), F.array_join(F.array_sort("added"), "|").alias("added"))


@query("u4_common_tag", "works tags", """SELECT src, dst, list_min(list_intersect(a.l, b.l)) AS common_tag FROM pairs
 JOIN (SELECT work_id, list(tag) AS l FROM tags GROUP BY 1) a ON a.work_id = src JOIN (SELECT work_id, list(tag) AS l FROM tags GROUP BY 1) b ON b.work_id = dst""", {
    "pairs": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey"})
def _(t: Tables):
    from ostinato.plans.queries_similarity import bought_pairs

    lists = tags_of_works(t.tags)
    a = lists.select(F.col("work_id").alias("src"), F.col("tags").alias("a"))
    b = lists.select(F.col("work_id").alias("dst"), F.col("tags").alias("b"))
    common = bought_pairs(t).join(a, "src").join(b.hint("shuffle_hash"), "dst").select("src", "dst", F.array_min(F.array_intersect("a", "b")).alias("common_tag"))
    return similarity.both_directions(common, ["common_tag"], ["common_tag"], ["common_tag"])


@query("u5_merge_review", "works tags", """, a AS (SELECT work_id, tag, source, confidence FROM tags WHERE source = 'auto-tagger'),
 c AS (SELECT work_id, unnest(new_tags) AS tag FROM decisions WHERE decision = 'corrected')
SELECT work_id, tag, source, confidence FROM a WHERE work_id NOT IN (SELECT work_id FROM decisions WHERE decision IN ('rejected', 'corrected'))
UNION ALL SELECT a.work_id, a.tag, source, confidence FROM a JOIN c ON a.work_id = c.work_id AND a.tag = c.tag
UNION ALL SELECT c.work_id, c.tag, 'human-review', 1.0 FROM c LEFT JOIN a ON a.work_id = c.work_id AND a.tag = c.tag WHERE a.tag IS NULL""", OLD_NEW_SQL | DECISIONS_SQL)
def _(t: Tables):
    return tg.merge_review(t.tags.filter("source = 'auto-tagger'"), decisions(t))


# --- metrics ---------------------------------------------------------------------------------------------

COVER = """SELECT CAST((SELECT count(*) FROM works) AS BIGINT) AS total_works, CAST(count(*) AS BIGINT) AS tagged_works,
 CAST((SELECT count(*) FROM works) - count(*) AS BIGINT) AS untagged_works, round(100.0 * count(*) / (SELECT count(*) FROM works), 2) AS coverage_pct,
 CAST(sum(n) AS BIGINT) AS total_tag_associations, round(avg(n), 2) AS avg_tags_per_work, CAST(min(n) AS BIGINT) AS min_tags_per_work,
 CAST(max(n) AS BIGINT) AS max_tags_per_work, CAST(median(n) AS DOUBLE) AS median_tags_per_work FROM (SELECT work_id, count(*) AS n FROM {t} GROUP BY 1)"""
DIVERSE = """SELECT CAST(count(*) AS BIGINT) AS unique_tags, CAST(sum(n) AS BIGINT) AS total_uses, round(-sum(p * log2(p)), 3) AS entropy,
 round(-sum(p * log2(p)) / log2(count(*)), 3) AS normalized_entropy, round(100.0 * sum(CASE WHEN r <= 5 THEN n END) / sum(n), 2) AS top_5_concentration_pct
 FROM (SELECT tag, count(*) AS n, count(*) / sum(count(*)) OVER () AS p, row_number() OVER (ORDER BY count(*) DESC, tag) AS r FROM {t} GROUP BY tag)"""


@query("a7_tag_coverage", "works tags", COVER.format(t="tags"))
def _(t: Tables):
    return tm.coverage(t.tags, t.works)


@query("a8_tag_diversity", "tags", DIVERSE.format(t="tags"))
def _(t: Tables):
    return tm.diversity(t.tags)


@query("a8_tag_extremes", "tags", """, c AS (SELECT tag, count(*) AS uses FROM tags GROUP BY 1)
(SELECT 'most' AS side, tag, CAST(uses AS BIGINT) AS uses FROM c ORDER BY uses DESC, tag LIMIT 10) UNION ALL (SELECT 'least', tag, uses FROM c ORDER BY uses, tag DESC LIMIT 10)""")
def _(t: Tables):
    return tm.tag_extremes(t.tags)


@query("a10_before_after", "works tags", f""", old AS (SELECT * FROM tags WHERE source = 'musicbrainz'), oc AS ({COVER.format(t='old')}), nc AS ({COVER.format(t='tags')}),
 od AS ({DIVERSE.format(t='old')}), nd AS ({DIVERSE.format(t='tags')})
SELECT oc.coverage_pct AS before_coverage_pct, nc.coverage_pct AS after_coverage_pct, od.unique_tags AS before_unique_tags, nd.unique_tags AS after_unique_tags,
 round(nc.coverage_pct - oc.coverage_pct, 2) AS delta_coverage_pct, round(nc.avg_tags_per_work - oc.avg_tags_per_work, 2) AS delta_avg_tags_per_work,
 CAST(nc.total_tag_associations - oc.total_tag_associations AS BIGINT) AS delta_total_tag_associations, nd.unique_tags - od.unique_tags AS delta_unique_tags,
 round(nd.normalized_entropy - od.normalized_entropy, 3) AS delta_normalized_entropy FROM oc, nc, od, nd""")
def _(t: Tables):
    return tm.compare(t.tags.filter("source = 'musicbrainz'"), t.tags, t.works).select(
        "before_coverage_pct", "after_coverage_pct", "before_unique_tags", "after_unique_tags", "delta_coverage_pct",
        "delta_avg_tags_per_work", "delta_total_tag_associations", "delta_unique_tags", "delta_normalized_entropy")


@query("a11_overall_score", "works tags", f""", c AS ({COVER.format(t='tags')}), d AS ({DIVERSE.format(t='tags')}),
 s AS (SELECT (least(coverage_pct / 100, 1.0) + normalized_entropy + least(avg_tags_per_work / 7, 1.0)) / 3 AS s FROM c, d)
SELECT round(s, 6) AS overall_score, CASE WHEN s >= 0.8 THEN 'EXCELLENT' WHEN s >= 0.6 THEN 'GOOD' ELSE 'NEEDS IMPROVEMENT' END AS grade FROM s""")
def _(t: Tables):
    return tm.overall_score(t.tags, t.works).select(F.round("overall_score", 6).alias("overall_score"), "grade")


@query("a12_origin_stats", "works tags", """, w AS (SELECT count(*) AS n FROM works), p AS (SELECT work_id, count(*) AS n, count(*) FILTER (source = 'musicbrainz') AS s, count(*) FILTER (source = 'auto-tagger') AS a FROM tags GROUP BY 1)
SELECT CAST(any_value(w.n) AS BIGINT) AS total_works, CAST(count(*) FILTER (s > 0) AS BIGINT) AS source_works, CAST(count(*) FILTER (a > 0) AS BIGINT) AS auto_works, CAST(count(*) AS BIGINT) AS any_tags,
 CAST(any_value(w.n) - count(*) AS BIGINT) AS untagged, CAST(sum(p.n) AS BIGINT) AS entries, CAST(sum(s) AS BIGINT) AS source_entries, CAST(sum(a) AS BIGINT) AS auto_entries,
 round(100.0 * count(*) FILTER (s > 0) / any_value(w.n), 1) AS source_works_pct FROM p, w""")
def _(t: Tables):
    return tg.origin_stats(t.tags, t.works).select(
        "total_works", "source_works", "auto_works", "any_tags", "untagged", "entries", "source_entries", "auto_entries", "source_works_pct")


# --- corrections --------------------------------------------------------------------------------------------

CHANGES = {"changes": """SELECT 'removed' AS change, coalesce(work_type, 'unknown') AS work_type, coalesce(CAST(composer_id AS VARCHAR), 'unknown') AS composer_id, unnest(removed) AS tag FROM corrections
 UNION ALL SELECT 'added', coalesce(work_type, 'unknown'), coalesce(CAST(composer_id AS VARCHAR), 'unknown'), unnest(added) FROM corrections"""}


@query("a14_top_changes", "works tags", """SELECT change, tag, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY change ORDER BY n DESC, tag) AS INT) AS rank
 FROM (SELECT change, tag, count(*) AS n FROM changes GROUP BY 1, 2) QUALIFY rank <= 10""", CORR | CHANGES)
def _(t: Tables):
    return corr.top_changes(derived_corrections(t))


@query("a14_changes_by_work_type", "works tags", "SELECT change, work_type, tag, CAST(count(*) AS BIGINT) AS n FROM changes GROUP BY 1, 2, 3", CORR | CHANGES)
def _(t: Tables):
    return corr.change_counts(derived_corrections(t), "work_type")


@query("a14_changes_by_composer", "works tags", "SELECT change, composer_id, tag, CAST(count(*) AS BIGINT) AS n FROM changes GROUP BY 1, 2, 3", CORR | CHANGES)
def _(t: Tables):
    return corr.change_counts(derived_corrections(t), "composer_id")


RULES = {
    "byt": "SELECT work_type, tag, count(*) AS n FROM changes WHERE change = 'added' AND work_type <> 'unknown' GROUP BY 1, 2",
    "best": "SELECT * FROM byt QUALIFY row_number() OVER (PARTITION BY work_type ORDER BY n DESC, tag) = 1",
    "top": "SELECT change, tag, n, row_number() OVER (PARTITION BY change ORDER BY n DESC, tag) AS r FROM (SELECT change, tag, count(*) AS n FROM changes GROUP BY 1, 2)",
}


@query("a15_correction_rules", "works tags", """SELECT 'work_type_missing_tag' AS type, work_type, tag, CAST(n AS BIGINT) AS frequency, concat(work_type, ' works often need ''', tag, ''' tag') AS description FROM best WHERE n >= 3
 UNION ALL SELECT 'frequently_incorrect_tag', NULL, tag, n, concat('Tag ''', tag, ''' is frequently incorrect (removed ', n, ' times)') FROM top WHERE change = 'removed' AND r <= 10 AND n >= 5""", CORR | CHANGES | RULES)
def _(t: Tables):
    return corr.patterns(derived_corrections(t))


@query("a15_suggestions", "works tags", """SELECT CASE change WHEN 'removed' THEN 1 ELSE 2 END AS slot, CASE change WHEN 'removed' THEN concat('Consider updating the prompt to be more careful about using ''', tag, ''' (removed ', n, ' times)')
 ELSE concat('The model often misses ''', tag, ''' - consider adding examples to the prompt (manually added ', n, ' times)') END AS suggestion FROM top WHERE r = 1 AND n >= 5
 UNION ALL (SELECT 3, concat('Add rule: ', work_type, ' works should usually include ''', tag, ''' tag') FROM best WHERE n >= 3 ORDER BY work_type LIMIT 3)""", CORR | CHANGES | RULES)
def _(t: Tables):
    return corr.suggestions(derived_corrections(t))


@query("a16_correction_totals", "works tags", """SELECT CAST(count(*) AS BIGINT) AS total_corrections, CAST(sum(len(removed)) AS BIGINT) AS total_tags_removed, CAST(sum(len(added)) AS BIGINT) AS total_tags_added,
 min("timestamp") AS first_correction, max("timestamp") AS last_correction, round(sum(len(removed)) / count(*), 2) AS avg_tags_removed, round(sum(len(added)) / count(*), 2) AS avg_tags_added FROM corrections""", CORR)
def _(t: Tables):
    return corr.totals(derived_corrections(t))


@query("a16_latest_corrections", "works tags", 'SELECT work_id, title, "timestamp" FROM corrections ORDER BY "timestamp" DESC, work_id LIMIT 10', CORR)
def _(t: Tables):
    return corr.latest(derived_corrections(t)).select("work_id", "title", "timestamp")


@query("a18_review_outcome", "works tags", """, o AS (SELECT count(*) FILTER (decision = 'approved') AS a, count(*) FILTER (decision = 'corrected') AS c, count(*) FILTER (decision = 'rejected') AS r, count(*) FILTER (decision = 'skipped') AS s FROM decisions)
SELECT CAST(a AS BIGINT) AS approved, CAST(c AS BIGINT) AS corrected, CAST(r AS BIGINT) AS rejected, CAST(s AS BIGINT) AS skipped, CAST(a + c + r AS BIGINT) AS total_reviewed,
 round((a + c) / (a + c + r), 6) AS approval_rate, (a + c) / (a + c + r) >= 0.8 AND s = 0 AS auto_approve FROM o""", OLD_NEW_SQL | DECISIONS_SQL)
def _(t: Tables):
    return tg.review_outcome(decisions(t)).withColumn("approval_rate", F.round("approval_rate", 6))


def run_results(t: Tables):
    """Results of a tagging run: all works, an error where no key is known."""
    return tg.rule_tags(t.works).join(t.works.select("work_id", "catalog_number", F.length("title").alias("n")), "work_id").select(
        "work_id", "tags", F.when(F.col("catalog_number").isNull(), "no catalog number").alias("error"),
        (F.col("n") * 10).alias("input_tokens"), F.col("n").alias("output_tokens"))


@query("a19_run_stats", "works", """, r AS (SELECT length(title) AS n, catalog_number IS NULL AS bad FROM works)
SELECT CAST(count(*) AS BIGINT) AS attempted, CAST(count(*) FILTER (bad) AS BIGINT) AS failed_requests, CAST(sum(n) * 10 AS BIGINT) AS input_tokens, CAST(sum(n) AS BIGINT) AS output_tokens,
 CAST(sum(n) * 11 AS BIGINT) AS total_tokens, round(sum(n) * 10 / 1e6 * 3, 3) AS input_cost_usd, round(sum(n) / 1e6 * 15, 3) AS output_cost_usd FROM r""")
def _(t: Tables):
    return tg.run_stats(run_results(t)).select(
        "attempted", "failed_requests", "input_tokens", "output_tokens", "total_tokens", "input_cost_usd", "output_cost_usd")


@query("a20_cost_estimate", "works tags", """, n AS (SELECT count(*) AS n FROM works WHERE work_id NOT IN (SELECT work_id FROM tags))
SELECT CAST(n AS BIGINT) AS total_works, CAST(n * 700 AS BIGINT) AS estimated_tokens, round(n * 0.0045, 3) AS estimated_cost_usd, round(n / 60, 1) AS estimated_time_minutes, n * 0.0045 <= 5 AS within_budget, 5.0::DOUBLE AS max_budget_usd FROM n""")
def _(t: Tables):
    return tg.cost_estimate(tg.untagged_works(t.works, t.tags))


# --- lookups and responses --------------------------------------------------------------------------------------

RESPONSE = """concat(CASE conv_id % 3 WHEN 0 THEN '```json' WHEN 1 THEN '```' ELSE '' END, '{"tags": ["', replace(role, 'user', 'dramatic'), '", "invalid-tag", "famous", "', CASE WHEN length("text") > 300 THEN 'lyrical' ELSE 'dark' END, '"]',
 CASE WHEN turn > 5 THEN '' ELSE '}' END, CASE WHEN conv_id % 3 < 2 THEN '```' ELSE '' END)"""


@query("f13_parse_responses", "", f"""SELECT conv_id, turn, CASE WHEN turn > 5 THEN '' ELSE concat_ws('|', CASE WHEN role = 'user' THEN 'dramatic' END, 'famous', CASE WHEN length("text") > 300 THEN 'lyrical' ELSE 'dark' END) END AS tags,
 CASE WHEN turn > 5 THEN 'JSON parse error' END AS error FROM conversations""")
def _(t: Tables):
    r = t.base("conversations").select("conv_id", "turn", F.expr(RESPONSE.replace('"text"', "text")).alias("response"))
    return tg.parse_responses(r).select("conv_id", "turn", F.array_join("tags", "|").alias("tags"), "error")


_category = "CASE " + " ".join(f"WHEN tag IN {_in(ts)} THEN '{c}'" for c, ts in TAXONOMY.items()) + " ELSE 'unknown' END"


@query("f14_tag_category", "tags", f"SELECT work_id, tag, source, {_category} AS category FROM tags")
def _(t: Tables):
    return t.tags.select("work_id", "tag", "source", tg.tag_category(F.col("tag")).alias("category"))


@query("f15_tagging_context", "works composers", """SELECT work_id, concat_ws(chr(10), concat('Title: ', title),
 CASE WHEN name IS NOT NULL THEN concat('Composer: ', name, CASE WHEN period IS NOT NULL THEN concat(' (', period, CASE WHEN birth_year IS NULL THEN '' WHEN death_year IS NOT NULL THEN concat(', ', birth_year, '-', death_year) ELSE concat(', b. ', birth_year) END, ')') ELSE '' END) END,
 CASE WHEN work_type IS NOT NULL THEN concat('Type: ', work_type) END, CASE WHEN key IS NOT NULL THEN concat('Key: ', key) END, CASE WHEN catalog_number IS NOT NULL THEN concat('Catalog: ', catalog_number) END) AS context
 FROM works w LEFT JOIN composers c ON w.composer_id = c.composer_id""")
def _(t: Tables):
    return tg.tagging_context(t.works, t.composers)


# --- pipeline steps -------------------------------------------------------------------------------------------------

def _rule_tags_sql(pending: str) -> dict[str, str]:
    """Rule tags of the pending works, for the checking engine."""
    from ostinato.plans.queries_semantic import _moods_sql

    lists = [f"CASE WHEN contains(lower(title), '{p}') THEN {list(ts)} ELSE CAST([] AS VARCHAR[]) END" for p, ts in PLAYFUL_PATTERNS.items()]
    lists.append("CASE WHEN contains(lower(title), 'galopade') THEN ['playful', 'elegant'] ELSE CAST([] AS VARCHAR[]) END")
    lists.append("CASE WHEN contains(lower(title), 'waltz') AND contains(lower(key), 'major') THEN ['cheerful', 'lighthearted'] ELSE CAST([] AS VARCHAR[]) END")
    lists.append(f"coalesce(string_split({_moods_sql('key')}, ' '), CAST([] AS VARCHAR[]))")
    both = lists[0]
    for x in lists[1:]:
        both = f"list_concat({both}, {x})"
    return {"made": f"""SELECT DISTINCT work_id, tag FROM (SELECT work_id, unnest({both}) AS tag FROM works WHERE {pending}) WHERE tag IN {_in(tg.ALL_TAGS)}"""}


UNTAGGED_SQL = "work_id NOT IN (SELECT work_id FROM tags)"
ENHANCE_SQL = "work_id IN (SELECT work_id FROM tags WHERE source = 'musicbrainz') AND work_id NOT IN (SELECT work_id FROM tags WHERE source = 'auto-tagger')"


@query("g1_rule_tagging", "works tags", "SELECT work_id, tag, 'auto-tagger' AS source, 1.0::DOUBLE AS confidence FROM made", _rule_tags_sql(UNTAGGED_SQL))
def _(t: Tables):
    pending = tg.untagged_works(t.works, t.tags)
    return tg.tag_rows(tg.rule_tags(pending), F.lit("2024-01-01").cast("timestamp")).drop("created_at")


@query("g2_resume", "works tags", """SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (work_id IN (SELECT work_id FROM tags WHERE source = 'auto-tagger')) AS BIGINT) AS processed,
 CAST(count(*) FILTER (work_id NOT IN (SELECT work_id FROM tags WHERE source = 'auto-tagger')) AS BIGINT) AS remaining FROM works""")
def _(t: Tables):
    done = t.tags.filter("source = 'auto-tagger'").select("work_id").distinct()
    left = tg.pending_works(t.works, done)
    row = tg.progress(t.works, done)
    from ostinato.operators.shape import one_row
    return one_row(row.select("total", "processed"), left.agg(F.count("*").alias("remaining")))


@query("g3_review_confidence", "tags", "SELECT DISTINCT work_id FROM tags WHERE confidence < 0.7")
def _(t: Tables):
    return tg.review_selection(t.tags, "confidence")


@query("g3_review_full", "tags", "SELECT DISTINCT work_id FROM tags")
def _(t: Tables):
    return tg.review_selection(t.tags, "full")


@query("g3_review_quick", "tags", f"SELECT work_id FROM (SELECT DISTINCT work_id FROM tags) ORDER BY {draw_sql('work_id')}, work_id LIMIT 25")
def _(t: Tables):
    return tg.review_selection(t.tags, "quick", 25)


@query("g4_apply_edits", "works tags", """SELECT work_id, array_to_string(list_concat(list_filter(old_tags, lambda x: x NOT IN ('romantic', 'ring')), ['heroic']), '|') AS new_tags FROM old_new""", OLD_NEW_SQL)
def _(t: Tables):
    e = edits(t)
    changes = e.select("work_id", F.array(F.lit("romantic"), F.lit("ring")).alias("remove"), F.array(F.lit("heroic"), F.lit("not-a-tag")).alias("add"))
    return tg.apply_edits(e.select("work_id", F.col("old_tags").alias("tags")), changes).select("work_id", F.array_join("new_tags", "|").alias("new_tags"))


@query("g5_capture_corrections", "works tags", """SELECT work_id, title, work_type, array_to_string(removed, '|') AS removed, array_to_string(added, '|') AS added, reviewer, 'checked' AS reason FROM corrections""", CORR)
def _(t: Tables):
    return derived_corrections(t).select(
        "work_id", "title", "work_type", F.array_join(F.array_sort("removed"), "|").alias("removed"), F.array_join(F.array_sort("added"), "|").alias("added"), "reviewer", "reason")
