"""Queries: lookup, search, filters, joins and decoration of works."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.operators import catalog, recommend
from ostinato.operators.shape import numbered
from ostinato.plans.common import LISTS_SQL, embedding_edges
from ostinato.plans.queries_semantic import ROWS_SQL, SIM_SQL, shown
from ostinato.plans.registry import query
from ostinato.plans.views import Tables


@query("p4_work_by_id", "works", "SELECT work_id, title, work_type FROM works WHERE work_id = 77")
def _(t: Tables):
    return catalog.work_by_id(t.works, 77).select("work_id", "title", "work_type")


@query("p5_search_titles", "works", "SELECT work_id, title FROM works WHERE contains(lower(title), 'concerto in d') ORDER BY work_id LIMIT 10")
def _(t: Tables):
    return catalog.search_titles(t.works, "Concerto in D").select("work_id", "title")


@query("p6_filter_works", "works composers", """SELECT w.work_id, title, c.period FROM works w JOIN composers c USING (composer_id)
 WHERE work_type = 'Sonata' AND key = 'E minor' AND c.period = 'Baroque'""")
def _(t: Tables):
    return catalog.filter_works(t.works, t.composers, work_type="Sonata", key="E minor", period="Baroque").select("work_id", "title", "period")


@query("p7_browse", "works composers", """SELECT work_id, title, 1.0::DOUBLE AS score, CAST(row_number() OVER (ORDER BY work_id) AS INT) AS rank FROM works
 WHERE composer_id = (SELECT min(composer_id) FROM composers WHERE contains(lower(name), '#000000004')) AND work_type = 'Nocturne' ORDER BY work_id LIMIT 10""")
def _(t: Tables):
    return catalog.browse(t.works, t.composers, composer="#000000004", work_type="Nocturne").select("work_id", "title", "score", "rank")


@query("p7_browse_rows", "works composers tags", ROWS_SQL.format(first="", why="CAST(NULL AS VARCHAR)", more=""), {"pairs": """SELECT work_id AS dst, 1.0::DOUBLE AS score, CAST(row_number() OVER (ORDER BY work_id) AS INT) AS rank FROM works
 WHERE composer_id = (SELECT min(composer_id) FROM composers WHERE contains(lower(name), '#000000004')) AND work_type = 'Nocturne' ORDER BY work_id LIMIT 10""", "five": SIM_SQL["five"]})
def _(t: Tables):
    return shown(recommend.browse(t.works, t.composers, t.cards, composer="#000000004", work_type="Nocturne"))


@query("j2_works_with_composers", "works composers", """SELECT work_id, w.composer_id, name, period, country, birth_year, death_year FROM works w
 LEFT JOIN composers c ON w.composer_id = c.composer_id""")
def _(t: Tables):
    return catalog.with_composers(t.works, t.composers).select("work_id", "composer_id", "name", "period", "country", "birth_year", "death_year")


@query("j3_period_distribution", "works composers", """SELECT coalesce(period, 'Unknown') AS period, work_type, CAST(count(*) AS BIGINT) AS n FROM works w
 LEFT JOIN composers c ON w.composer_id = c.composer_id GROUP BY 1, 2""")
def _(t: Tables):
    j = catalog.with_composers(t.works, t.composers, ["period"])
    return j.groupBy(F.coalesce("period", F.lit("Unknown")).alias("period"), "work_type").agg(F.count("*").alias("n"))


@query("j14_decorate", "works composers tags", """, d AS (SELECT list_id, work_id, score, rank FROM lists),
 g AS (SELECT work_id, string_agg(tag, '|' ORDER BY tag, source) AS tags FROM (SELECT * FROM tags QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY tag, source) <= 5) GROUP BY 1)
SELECT list_id, d.work_id, title, coalesce(name, 'Unknown') AS composer, w.work_type, w.key, c.period, d.score, d.rank, g.tags
FROM d LEFT JOIN works w ON d.work_id = w.work_id LEFT JOIN composers c ON w.composer_id = c.composer_id LEFT JOIN g ON g.work_id = d.work_id""", LISTS_SQL)
def _(t: Tables):
    out = catalog.decorate(embedding_edges(t), t.works, t.composers, t.tags)
    return out.withColumn("tags", F.array_join("tags", "|"))


@query("j15_work_cards", "works composers tags", """SELECT w.work_id, title, coalesce(name, 'Unknown') AS composer, work_type, key, catalog_number, coalesce(tags, '') AS tags
 FROM works w LEFT JOIN composers c ON w.composer_id = c.composer_id LEFT JOIN (SELECT work_id, string_agg(tag, '|' ORDER BY tag) AS tags FROM tags GROUP BY 1) g ON g.work_id = w.work_id""")
def _(t: Tables):
    return catalog.work_cards(t.works, t.composers, t.tags).withColumn("tags", F.array_join("tags", "|")).drop("period")


@query("j15_share_cards", "dirty_works composers", """SELECT work_id, coalesce(title, 'Untitled') AS title, coalesce(name, 'Unknown') AS composer, work_type, period, key
 FROM dirty_works w LEFT JOIN composers c ON w.composer_id = c.composer_id""")
def _(t: Tables):
    return catalog.share_cards(t.dirty_works, t.composers).drop("instrumentation")


@query("j17_popular_cards", "works", """SELECT work_id, title, query, md5(concat(work_id, '-', query)) AS card_key FROM (SELECT * FROM works ORDER BY work_id LIMIT 10)
 CROSS JOIN (VALUES ('moody'), ('studying'), ('relaxing'), ('dark academia'), ('cozy')) AS q(query)""")
def _(t: Tables):
    return catalog.popular_cards(t.works)


@query("a6_first_tags", "tags", """SELECT work_id, string_agg(tag, '|' ORDER BY tag, source) AS tags FROM (SELECT * FROM tags
 QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY tag, source) <= 2) GROUP BY 1""")
def _(t: Tables):
    return catalog.tags_of_works(t.tags, 2).withColumn("tags", F.array_join("tags", "|"))


@query("a6_tags_per_work", "tags", "SELECT work_id, string_agg(tag, '|' ORDER BY tag) AS tags, CAST(count(*) AS INT) AS n FROM tags GROUP BY 1")
def _(t: Tables):
    return catalog.tags_of_works(t.tags).select("work_id", F.array_join("tags", "|").alias("tags"), F.size("tags").alias("n"))


@query("w1_rank_history", "history", """SELECT user_id, work_id, relevance_score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY relevance_score DESC, work_id, seq, rank) AS INT) AS place FROM history""")
def _(t: Tables):
    return numbered(t.history, ["user_id"], [F.desc("relevance_score"), F.col("work_id"), F.col("seq"), F.col("rank")], "place").select(
        "user_id", "work_id", "relevance_score", "place")
