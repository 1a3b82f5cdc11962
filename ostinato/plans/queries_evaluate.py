"""Queries: evaluation of lists and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.functions.fixed_values import MOOD_QUERIES
from ostinato.operators import evaluate as ev
from ostinato.operators import recommend, rerank, semantic
from ostinato.operators.catalog import search_titles, tags_of_works, with_composers
from ostinato.operators.tags import unite
from ostinato.plans.common import CENTROID_SQL, DOT_SQL, FEATURES_SQL, LISTS_SQL, centroid_results, draw_sql, embedding_lists, hashed_sql
from ostinato.plans.queries_semantic import EXPANSION_SQL, SEM_SENTENCE, SEM_STEPS, SIM_SQL, shown
from ostinato.plans.registry import ORACLES, query
from ostinato.plans.views import Tables
from ostinato.session import cut

WC = "works composers"


def _round(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


GINI = "round(2.0 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*), 6)"


@query("a24_gini", "history", f"SELECT CAST(count(*) AS BIGINT) AS n, {GINI} AS gini FROM (SELECT n AS x, row_number() OVER (ORDER BY n) AS i FROM (SELECT work_id, count(*) AS n FROM history GROUP BY 1))")
def _(t: Tables):
    counts = t.history.groupBy("work_id").agg(F.count("*").alias("n"))
    return ev.gini(counts, "n").withColumn("gini", F.round("gini", 6))


@query("a24_gini_per_vibe", "history", f"SELECT vibe, CAST(count(*) AS BIGINT) AS n, {GINI} AS gini FROM (SELECT vibe, n AS x, row_number() OVER (PARTITION BY vibe ORDER BY n) AS i FROM (SELECT vibe, work_id, count(*) AS n FROM history GROUP BY 1, 2)) GROUP BY vibe")
def _(t: Tables):
    counts = t.history.groupBy("vibe", "work_id").agg(F.count("*").alias("n"))
    return ev.gini(counts, "n", ["vibe"]).withColumn("gini", F.round("gini", 6))


DIV = {
    "pc": "SELECT list_id, composer, count(*) AS c FROM lists GROUP BY 1, 2",
    "gi": f"SELECT list_id, {GINI} AS gini_coefficient FROM (SELECT list_id, c AS x, row_number() OVER (PARTITION BY list_id ORDER BY c) AS i FROM pc) GROUP BY 1",
    "pd": "SELECT a.list_id, avg(abs(a.score - b.score)) AS d FROM lists a JOIN lists b ON a.list_id = b.list_id AND a.rank < b.rank GROUP BY 1",
    "div": """SELECT l.list_id, any_value(d) AS avg_pairwise_dissimilarity, count(DISTINCT composer) / count(*) AS unique_composers_ratio,
 CASE WHEN count(work_type) > 0 THEN count(DISTINCT work_type) / count(work_type) ELSE 0 END AS unique_work_types_ratio,
 CASE WHEN count(period) > 0 THEN count(DISTINCT period) / count(period) ELSE 0 END AS unique_periods_ratio,
 (SELECT max(c) FROM pc WHERE pc.list_id = l.list_id) / count(*) AS max_same_composer_ratio, any_value(gini_coefficient) AS gini_coefficient
 FROM lists l JOIN gi ON gi.list_id = l.list_id JOIN pd ON pd.list_id = l.list_id GROUP BY l.list_id""",
}
RATIOS = ("avg_pairwise_dissimilarity", "unique_composers_ratio", "unique_work_types_ratio", "unique_periods_ratio", "max_same_composer_ratio", "gini_coefficient")


@query("e1_list_diversity", WC, "SELECT list_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in RATIOS) + " FROM div", LISTS_SQL | DIV)
def _(t: Tables):
    return _round(ev.list_diversity(embedding_lists(t)), *RATIOS)


COV = """SELECT CAST(count(DISTINCT work_id) AS BIGINT) AS works_ever_recommended, CAST((SELECT count(*) FROM embeddings) AS BIGINT) AS total_catalog_size,
 round(count(DISTINCT work_id) / (SELECT count(*) FROM embeddings), 6) AS coverage_ratio, CAST(count(DISTINCT composer) AS BIGINT) AS composers_covered,
 CAST(count(DISTINCT period) AS BIGINT) AS periods_covered, CAST(count(DISTINCT work_type) AS BIGINT) AS work_types_covered,
 CAST((SELECT count(DISTINCT work_type) FROM works) AS BIGINT) AS work_types_total, CAST((SELECT count(DISTINCT period) FROM composers) AS BIGINT) AS periods_total,
 round(count(*) / count(DISTINCT work_id), 6) AS avg_recommendations_per_work, (SELECT CAST(median(n) AS DOUBLE) FROM (SELECT count(*) AS n FROM lists GROUP BY work_id)) AS median_recommendations_per_work FROM lists"""


def catalog_of_vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("work_id")).join(t.works.select("work_id", "work_type"), "work_id", "left")


@query("e2_catalog_coverage", WC, COV.replace("(SELECT count(DISTINCT work_type) FROM works)", "(SELECT count(DISTINCT work_type) FROM works JOIN e ON e.vec_id = work_id)"), LISTS_SQL)
def _(t: Tables):
    c = ev.catalog_coverage(embedding_lists(t), catalog_of_vectors(t), t.composers)
    return _round(c.drop("composers_total"), "coverage_ratio", "avg_recommendations_per_work")


@query("e2_most_recommended", WC, "SELECT work_id, CAST(count(*) AS BIGINT) AS n FROM lists GROUP BY 1 ORDER BY n DESC, work_id LIMIT 10", LISTS_SQL)
def _(t: Tables):
    return ev.most_recommended(embedding_lists(t))


@query("e2_sampled_coverage", WC, COV.replace("(SELECT count(DISTINCT work_type) FROM works)", "(SELECT count(DISTINCT work_type) FROM works JOIN e ON e.vec_id = work_id)").replace("FROM lists", "FROM few"),
       LISTS_SQL | {"few": f"SELECT * FROM lists WHERE list_id IN (SELECT vec_id FROM embeddings ORDER BY {draw_sql('vec_id')}, vec_id LIMIT 100)"})
def _(t: Tables):
    lists = embedding_lists(t)
    seeds = rerank.sample_works(t.embeddings, 100, id_col="vec_id").select(F.col("vec_id").alias("list_id"))
    c = ev.catalog_coverage(lists.join(seeds, "list_id", "left_semi"), catalog_of_vectors(t), t.composers)
    return _round(c.drop("composers_total"), "coverage_ratio", "avg_recommendations_per_work")


DIST = """SELECT round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(stddev_pop(score), 6) AS std, min(score) AS min, max(score) AS max,
 round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.75), 6) AS q75, CAST(count(*) AS BIGINT) AS n_samples FROM lists"""


@query("e3_score_distribution", WC, DIST, LISTS_SQL)
def _(t: Tables):
    return _round(ev.score_distribution(embedding_lists(t)), "mean", "median", "std", "q25", "q75")


CASES_SQL = FEATURES_SQL | {
    "cases": """SELECT * FROM (VALUES ('baroque_concerto_similarity', 'concerto', 'concerto', 7, 0.05), ('symphony_diversity', 'symphony', NULL, 6, 0.05), ('opera_recommendations', 'opera', 'opera', NULL, 0.05))
 AS c(name, seed_query, must_type, max_same_composer, min_score)""",
    "cseed": "SELECT name AS list_id, (SELECT min(work_id) FROM works WHERE contains(lower(title), seed_query)) AS seed FROM cases",
    "crecs": f"""SELECT list_id, b.work_id, b.name AS composer, lower(b.work_type) AS work_type, round(({DOT_SQL}) / sqrt(a.n2 * b.n2), 6) AS score
 FROM cseed JOIN featn a ON a.work_id = seed JOIN featn b ON b.work_id <> seed
 QUALIFY row_number() OVER (PARTITION BY list_id ORDER BY round(({DOT_SQL}) / sqrt(a.n2 * b.n2), 6) DESC, b.work_id) <= 10""",
    "cpass": """SELECT c.name, coalesce((SELECT min(score) FROM crecs r WHERE r.list_id = c.name) >= min_score, false)
  AND (must_type IS NULL OR must_type IN (SELECT work_type FROM crecs r WHERE r.list_id = c.name))
  AND (max_same_composer IS NULL OR (SELECT max(n) FROM (SELECT count(*) AS n FROM crecs r WHERE r.list_id = c.name GROUP BY composer)) <= max_same_composer) AS passed FROM cases c""",
}


def case_lists(t: Tables):
    """Ten content recommendations per expectation case, from the first title match."""
    from ostinato.functions.fixed_values import EXPECTATION_CASES
    from ostinato.operators.similarity import similar_to

    rows = t.features
    lists = []
    for name, text, *_rest in EXPECTATION_CASES:
        seed = search_titles(t.works, text, 1).select("work_id").collect()
        if seed:
            lists.append(similar_to(rows, seed[0][0]).withColumn("list_id", F.lit(name)))
    return unite(lists).join(rows.select("work_id", F.col("name").alias("composer"), "work_type"), "work_id")


@query("e4_expectation_cases", "works composers tags", "SELECT name, passed FROM cpass", CASES_SQL)
def _(t: Tables):
    return ev.check_cases(ev.case_table(t.spark), case_lists(t)).select("name", "passed")


@query("e5_full_report", "works composers tags", f"""SELECT section, metric, round(value, 6) AS value FROM (
 SELECT 'similarity_distribution' AS section, unnest(['mean','median','std','min','max','q25','q75','n_samples']) AS metric, unnest([mean, median, std, min, max, q25, q75, n_samples]) AS value FROM ({DIST})
 UNION ALL SELECT 'coverage', unnest(['works_ever_recommended','avg_recommendations_per_work','coverage_ratio']), unnest([works_ever_recommended, avg_recommendations_per_work, coverage_ratio]) FROM ({COV})
 UNION ALL SELECT 'diversity', unnest(['avg_pairwise_dissimilarity','unique_composers_ratio','gini_coefficient']), unnest([avg(avg_pairwise_dissimilarity), avg(unique_composers_ratio), avg(gini_coefficient)]) FROM div
 UNION ALL SELECT 'cases', unnest(['total','passed']), unnest([count(*), count(*) FILTER (passed)]) FROM cpass)""", LISTS_SQL | DIV | CASES_SQL)
def _(t: Tables):
    lists = cut(embedding_lists(t), "lists")
    r = ev.full_report(lists, catalog_of_vectors(t), t.composers, ev.check_cases(ev.case_table(t.spark), case_lists(t)), None)
    keep = ["works_ever_recommended", "avg_recommendations_per_work", "coverage_ratio", "avg_pairwise_dissimilarity", "unique_composers_ratio",
            "gini_coefficient", "total", "passed"]
    return r.filter((F.col("section") == "similarity_distribution") | F.col("metric").isin(keep)).withColumn("value", F.round("value", 6))


# --- searches ---------------------------------------------------------------------------------------

SEARCH_SQL = CENTROID_SQL | {
    "res": """SELECT CAST(query_id AS VARCHAR) AS query, vec_id AS work_id, score, CAST(label AS VARCHAR) AS composer, w.key, c.period, w.work_type, tg FROM results r LEFT JOIN works w ON w.work_id = vec_id
 LEFT JOIN composers c ON c.composer_id = w.composer_id LEFT JOIN (SELECT work_id, string_agg(tag, ' ' ORDER BY tag) AS tg FROM (SELECT * FROM tags QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY tag, source) <= 5) GROUP BY 1) g ON g.work_id = vec_id"""}
EXPECTED = [("major", 0), ("minor", 1), ("romantic", 2), ("sonata", 3), ("gear", 4)]


def search_results(t: Tables):
    r = centroid_results(t).select(F.col("query_id").cast("string").alias("query"), F.col("vec_id").alias("work_id"), "score")
    meta = with_composers(t.works, t.composers, ["period"]).select("work_id", "key", "period", "work_type")
    labels = t.embeddings.select(F.col("vec_id").alias("work_id"), F.col("label").cast("string").alias("composer"))
    return r.join(labels, "work_id").join(meta, "work_id", "left").join(tags_of_works(t.tags, 5), "work_id", "left")


@query("e6_query_evaluation", "works composers tags", f""", exp AS (SELECT DISTINCT CAST(label AS VARCHAR) AS query, f AS feature FROM embeddings CROSS JOIN (VALUES {', '.join(f"('{f}')" for f, _ in EXPECTED)}) AS x(f)),
 txt AS (SELECT query, lower(concat_ws(' ', coalesce(key, ''), coalesce(period, ''), coalesce(work_type, ''), coalesce(tg, ''))) AS x FROM res),
 fnd AS (SELECT e.query, e.feature, bool_or(contains(x, e.feature)) AS hit FROM exp e LEFT JOIN txt USING (query) GROUP BY 1, 2)
SELECT f.query, CAST(coalesce(any_value(b.n), 0) AS BIGINT) AS num_results, round(coalesce(any_value(b.s), 0), 9) AS avg_similarity, round(count(*) FILTER (hit) / count(*), 6) AS feature_coverage
 FROM fnd f LEFT JOIN (SELECT query, count(*) AS n, avg(score) AS s FROM res GROUP BY 1) b ON b.query = f.query GROUP BY f.query""", SEARCH_SQL)
def _(t: Tables):
    expected = t.embeddings.select(F.col("label").cast("string").alias("query")).distinct().select(
        "query", F.explode(F.array(*[F.lit(f) for f, _n in EXPECTED])).alias("feature"))
    out = ev.evaluate_queries(search_results(t), expected)
    return _round(out, "feature_coverage").withColumn("avg_similarity", F.round("avg_similarity", 9))


_QUOTED = [(q.replace("'", "''"), [f.replace("'", "''") for f in fs]) for q, fs in MOOD_QUERIES]
MOOD_SQL = {
    "mq": f"SELECT query, CASE WHEN e <> '' THEN concat(query, ' ', e) ELSE query END AS txt FROM (SELECT *, {EXPANSION_SQL} AS e FROM (VALUES {', '.join(f"('{q}')" for q, _ in _QUOTED)}) AS x(query))",
    "mx": f"SELECT * FROM (VALUES {', '.join(f"('{q}', '{f}')" for q, fs in _QUOTED for f in fs)}) AS x(query, feature)",
    "texts": f"SELECT concat('w', work_id) AS id, description AS txt FROM ({ORACLES['f6_descriptions']}) UNION ALL SELECT concat('q', query), txt FROM mq",
    **hashed_sql("SELECT id, txt FROM texts", 384),
    "hits": """SELECT substr(q.id, 2) AS query, CAST(substr(w.id, 2) AS BIGINT) AS work_id, coalesce(round(list_cosine_similarity(q.v, w.v), 6), 0) AS score FROM hv q JOIN hv w ON q.id LIKE 'q%' AND w.id LIKE 'w%'
 WHERE score >= 0.15 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY score DESC, CAST(substr(w.id, 2) AS BIGINT)) <= 10""",
    "hx": """SELECT query, score, lower(concat_ws(' ', coalesce(key, ''), coalesce(period, ''), coalesce(work_type, ''), coalesce(tg, ''))) AS x FROM hits JOIN works w USING (work_id)
 LEFT JOIN composers c ON c.composer_id = w.composer_id LEFT JOIN (SELECT work_id, string_agg(tag, ' ' ORDER BY tag) AS tg FROM (SELECT * FROM tags QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY tag, source) <= 5) GROUP BY 1) g USING (work_id)""",
}


@query("e6_mood_query_evaluation", "works composers tags", """SELECT m.query, coalesce(any_value(b.n), 0) AS num_results, round(coalesce(any_value(b.s), 0), 9) AS avg_similarity,
 round(count(*) FILTER (EXISTS (SELECT 1 FROM hx WHERE hx.query = m.query AND contains(x, lower(m.feature)))) / count(*), 6) AS feature_coverage
 FROM mx m LEFT JOIN (SELECT query, count(*) AS n, avg(score) AS s FROM hx GROUP BY 1) b ON b.query = m.query GROUP BY m.query""", MOOD_SQL)
def _(t: Tables):
    """The fixed mood queries against descriptions of all works, with the built-in encoder."""
    expected = ev.expectations(t.spark)
    q = expected.select("query").distinct().select("query", semantic.expand_query(F.col("query")).alias("text"))
    works = semantic.describe_works(t.works, t.composers, t.tags).select(F.concat(F.lit("w"), "work_id").alias("id"), F.col("description").alias("text"))
    # queries and works share one vocabulary
    texts = cut(works.unionByName(q.select(F.concat(F.lit("q"), "query").alias("id"), "text")), "texts")
    vectors = cut(semantic.embed(texts, "id", "text"), "vectors")
    qv = vectors.filter("id LIKE 'q%'").select(F.expr("substr(id, 2)").alias("query"), "embedding")
    wv = vectors.filter("id LIKE 'w%'").select(F.expr("substr(id, 2)").cast("bigint").alias("work_id"), "embedding")
    found = semantic.search(qv, wv, 10, query_id="query", item_id="work_id").select("query", "work_id", "score")
    meta = with_composers(t.works, t.composers, ["period"]).select("work_id", "key", "period", "work_type")
    out = ev.evaluate_queries(found.join(meta, "work_id", "left").join(tags_of_works(t.tags, 5), "work_id", "left"), expected)
    return _round(out, "feature_coverage").withColumn("avg_similarity", F.round("avg_similarity", 9))


@query("v11_mood_search", "works composers tags", f""", c0 AS (SELECT w.work_id, title, key AS pk, nullif(lower(work_type), '') AS wl, work_type AS wt, period, coalesce(string_split(five, '|'), CAST([] AS VARCHAR[])) AS l, query FROM mdrawn x
  JOIN works w ON w.work_id = x.work_id LEFT JOIN composers c ON w.composer_id = c.composer_id LEFT JOIN five ON five.work_id = w.work_id),
{SEM_STEPS}, sx AS ({SEM_SENTENCE})
SELECT x.query, w.work_id, title, coalesce(name, 'Unknown') AS composer, work_type, key, period, score AS similarity_score, CAST(row_number() OVER (PARTITION BY x.query ORDER BY score DESC, w.work_id) AS INT) AS rank,
 sx.explanation, five AS tags FROM mdrawn x JOIN works w ON w.work_id = x.work_id LEFT JOIN composers c ON c.composer_id = w.composer_id LEFT JOIN five ON five.work_id = w.work_id LEFT JOIN sx ON sx.work_id = x.work_id AND sx.query = x.query""",
       {k: v for k, v in MOOD_SQL.items() if k not in ("mx", "hx")} | {
           "hits": MOOD_SQL["hits"].replace("<= 10", "<= 30"), "five": SIM_SQL["five"],
           "mdrawn": f"SELECT query, work_id, score FROM hits QUALIFY row_number() OVER (PARTITION BY query ORDER BY -ln({draw_sql('query', 'work_id')}) / greatest(score, 1e-12), work_id) <= 10"})
def _(t: Tables):
    """All fixed mood queries: expansion, encoder, threshold, draw, cards and explanations in one job."""
    q = t.spark.createDataFrame([(x,) for x, _ in MOOD_QUERIES], "query string")
    return shown(recommend.mood_search(q, semantic.describe_works(t.works, t.composers, t.tags), t.cards))


@query("e7_result_coverage", "works composers tags", """SELECT CAST((SELECT count(*) FROM embeddings) AS BIGINT) AS total_works_in_catalog, CAST(count(DISTINCT work_id) AS BIGINT) AS works_returned,
 CAST(count(DISTINCT query) AS BIGINT) AS queries_tested, round(count(DISTINCT work_id) / (SELECT count(*) FROM embeddings), 6) AS coverage_ratio FROM res""", SEARCH_SQL)
def _(t: Tables):
    return _round(ev.result_coverage(search_results(t), t.embeddings).drop("coverage_percentage"), "coverage_ratio")


@query("e8_result_diversity", "works composers tags", """SELECT query, CAST(count(*) AS BIGINT) AS num_results, CAST(count(DISTINCT composer) AS BIGINT) AS unique_composers, CAST(count(DISTINCT period) AS BIGINT) AS unique_periods,
 CAST(count(DISTINCT work_type) AS BIGINT) AS unique_work_types, CAST(count(DISTINCT key) AS BIGINT) AS unique_keys, round(count(DISTINCT composer) / count(*), 6) AS composer_diversity_ratio,
 round(count(DISTINCT period) / count(*), 6) AS period_diversity_ratio, round(count(DISTINCT work_type) / count(*), 6) AS work_type_diversity_ratio FROM res GROUP BY query""", SEARCH_SQL)
def _(t: Tables):
    return _round(ev.result_diversity(search_results(t)), "composer_diversity_ratio", "period_diversity_ratio", "work_type_diversity_ratio")


RUNS = {
    "pool": "SELECT query_id, vec_id, score FROM scored WHERE score >= 0.15 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 30",
    "runs": f"""SELECT CAST(query_id AS VARCHAR) AS query, run, vec_id AS work_id FROM pool, (SELECT unnest(range(1, 6)) AS run)
 QUALIFY row_number() OVER (PARTITION BY query_id, run ORDER BY -ln({draw_sql('query_id', 'vec_id', seed='41 + run')}) / greatest(score, 1e-12), vec_id) <= 10""",
    "ovl": """SELECT q.query, coalesce(sum(CASE WHEN x.work_id IS NOT NULL THEN 1 ELSE 0 END), 0) / 10 / 10 AS avg_overlap_ratio FROM (SELECT DISTINCT query FROM runs) q
 LEFT JOIN (SELECT a.query, a.work_id FROM runs a JOIN runs b ON a.query = b.query AND a.work_id = b.work_id AND a.run < b.run) x ON x.query = q.query GROUP BY 1"""}


def result_runs(t: Tables):
    """Five runs of the sampling search, each with a seed of its own."""
    valid = centroid_results(t, 30, 0.15).select("query_id", "vec_id", "score")
    runs = rerank.sampled_runs(valid, 10, "query_id", "vec_id", 5)
    return runs.select(F.col("query_id").cast("string").alias("query"), "run", F.col("vec_id").alias("work_id"))


@query("u6_run_overlap", "works composers tags", "SELECT query, round(avg_overlap_ratio, 6) AS avg_overlap_ratio FROM ovl", SEARCH_SQL | RUNS)
def _(t: Tables):
    return _round(ev.run_overlap(result_runs(t), 10), "avg_overlap_ratio")


@query("e9_overall_health", "works composers tags", """, m AS (SELECT (SELECT avg(s) FROM (SELECT query, avg(score) AS s FROM res GROUP BY 1)) AS a, (SELECT avg(avg_overlap_ratio) FROM ovl) AS b,
 (SELECT count(DISTINCT work_id) FROM res) / (SELECT count(*) FROM embeddings) AS c, (SELECT avg(d) FROM (SELECT count(DISTINCT composer) / count(*) AS d FROM res GROUP BY query)) AS d),
 h AS (SELECT 0.4 * a + 0.3 * b + 0.2 * c + 0.1 * d AS s FROM m)
SELECT round(s, 6) AS health_score, CASE WHEN s >= 0.75 THEN 'excellent' WHEN s >= 0.6 THEN 'good' WHEN s >= 0.4 THEN 'fair' ELSE 'poor' END AS overall_health FROM h""", SEARCH_SQL | RUNS)
def _(t: Tables):
    r = cut(search_results(t), "results")
    runs = result_runs(t)
    quality = r.groupBy("query").agg(F.avg("score").alias("avg_similarity"))
    out = ev.comprehensive(quality, ev.run_overlap(runs, 10), ev.result_coverage(r, t.embeddings), ev.result_diversity(r))
    return _round(out.select("health_score", "overall_health"), "health_score")

