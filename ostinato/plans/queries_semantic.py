"""Queries: descriptions, query expansion, embeddings, search, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.functions.fixed_values import CHARACTER_WORDS, KEY_MOODS, MAJOR_MOODS, MINOR_MOODS, QUERY_EXPANSIONS
from ostinato.operators import explain, interactions, rerank, semantic
from ostinato.operators.catalog import tags_of_works, with_composers
from ostinato.plans.common import CENTROID_SQL, centroid_results, centroids, draw_sql, hashed_sql
from ostinato.plans.registry import ORACLES, query
from ostinato.plans.views import Tables


def _moods_sql(key: str) -> str:
    whens = " ".join(f"WHEN '{k.lower()}' THEN '{v}'" for k, v in KEY_MOODS.items())
    return (f"CASE WHEN {key} IS NULL THEN NULL ELSE CASE lower({key}) {whens} ELSE CASE WHEN contains(lower({key}), 'minor') THEN '{MINOR_MOODS}' "
            f"WHEN contains(lower({key}), 'major') THEN '{MAJOR_MOODS}' ELSE '' END END END")


@query("f6_descriptions", "works composers tags", f""", j AS (SELECT w.*, coalesce(name, 'Unknown') AS name, period, {_moods_sql('key')} AS moods, g.tags FROM works w
 LEFT JOIN composers c ON w.composer_id = c.composer_id LEFT JOIN (SELECT work_id, string_agg(tag, ' ' ORDER BY tag) AS tags FROM tags GROUP BY 1) g ON g.work_id = w.work_id)
SELECT work_id, concat(concat_ws('. ', concat(title, ' by ', name, ' ', name, ' ', name), CASE WHEN period IS NOT NULL THEN concat(period, ' ', period, ' period') END,
 CASE WHEN work_type IS NOT NULL THEN concat(work_type, ' ', work_type) END, CASE WHEN moods <> '' THEN concat(key, ': ', moods, ' ', key, ': ', moods) END,
 CASE WHEN catalog_number IS NOT NULL THEN concat('Catalog: ', catalog_number) END, CASE WHEN tags IS NOT NULL THEN concat('Tags: ', tags, ' ', tags, ' ', tags) END,
 CASE WHEN catalog_number LIKE 'BWV%' THEN 'Baroque era counterpoint' WHEN catalog_number LIKE 'K.%' THEN 'Classical era elegance' WHEN catalog_number LIKE 'Op.%' THEN 'structured composition' END), '.') AS description FROM j""")
def _(t: Tables):
    return semantic.describe_works(t.works, t.composers, t.tags)


@query("f7_key_moods", "works", f"SELECT work_id, key, {_moods_sql('key')} AS moods FROM works")
def _(t: Tables):
    return t.works.select("work_id", "key", semantic.key_moods(F.col("key")).alias("moods"))


_QUERY = "CASE WHEN context <> '' THEN concat(activity, ' ', context) ELSE activity END"
EXPANSION_SQL = "concat_ws(' ', " + ", ".join(f"CASE WHEN contains(lower(query), '{k}') THEN '{v}' END" for k, v in QUERY_EXPANSIONS.items()) + ")"


@query("f8_expand_queries", "query_log", f", q AS (SELECT query_id, {_QUERY} AS query FROM query_log), x AS (SELECT *, {EXPANSION_SQL} AS e FROM q) "
       "SELECT query_id, CASE WHEN e <> '' THEN concat(query, ' ', e) ELSE query END AS expanded FROM x")
def _(t: Tables):
    q = t.query_log.select("query_id", semantic.activity_query(F.col("activity"), F.col("context")).alias("query"))
    return q.select("query_id", semantic.expand_query(F.col("query")).alias("expanded"))


@query("j18_keyword_hits", "query_log", f", q AS (SELECT query_id, {_QUERY} AS query FROM query_log), k AS (SELECT * FROM (VALUES "
       + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(QUERY_EXPANSIONS.items())) + ") AS k(ord, keyword, expansion)) "
       "SELECT query_id, ord, keyword, expansion FROM q JOIN k ON contains(lower(query), keyword)")
def _(t: Tables):
    q = t.query_log.select("query_id", semantic.activity_query(F.col("activity"), F.col("context")).alias("query"))
    return semantic.keyword_hits(q)


# --- explanations ----------------------------------------------------------------------------------

SIM_SQL = {
    "card": """SELECT w.work_id, w.composer_id, work_type, key, period, coalesce(l, CAST([] AS VARCHAR[])) AS l FROM works w LEFT JOIN composers c ON w.composer_id = c.composer_id
 LEFT JOIN (SELECT work_id, list(tag) AS l FROM tags GROUP BY 1) g ON g.work_id = w.work_id""",
    "sr": """SELECT src, dst, coalesce(a.composer_id = b.composer_id, false) AS sc, CASE WHEN a.period = b.period THEN b.period END AS p, CASE WHEN a.work_type = b.work_type THEN b.work_type END AS t,
  CASE WHEN a.key = b.key THEN concat('in ', b.key) END AS k, list_min(list_intersect(a.l, b.l)) AS style FROM pairs JOIN card a ON a.work_id = src JOIN card b ON b.work_id = dst""",
    "expl": """SELECT src, dst, CASE WHEN sc AND len(att) > 0 THEN concat('Like your selection, this is a ', array_to_string(att, ' '), ' by the same composer') WHEN sc THEN 'From the same composer as your selection'
 WHEN len(att) = 1 THEN concat('Like your selection, this is also ', att[1]) WHEN len(att) = 2 THEN concat('Shares ', att[1], ' and ', att[2], ' with your selection')
 WHEN len(att) = 3 THEN concat('Shares ', att[1], ', ', att[2], ', and ', att[3], ' with your selection') WHEN style IS NOT NULL THEN concat('Features similar ', style, ' character to your selection')
 ELSE 'Recommended based on overall musical similarity' END AS explanation FROM (SELECT *, list_filter([p, t, k], lambda x: x IS NOT NULL) AS att FROM sr)""",
    "five": "SELECT work_id, string_agg(tag, '|' ORDER BY tag, source) AS five FROM (SELECT * FROM tags QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY tag, source) <= 5) GROUP BY 1",
}
#: Full rows of ``pairs (src, dst, score, rank)``.
ROWS_SQL = """SELECT {first}w.work_id, title, coalesce(name, 'Unknown') AS composer, work_type, key, period, x.score AS similarity_score, x.rank, {why} AS explanation, five AS tags FROM pairs x JOIN works w ON w.work_id = x.dst
 LEFT JOIN composers c ON c.composer_id = w.composer_id LEFT JOIN five ON five.work_id = w.work_id {more}"""
EXPLAINED_SQL = ROWS_SQL.format(first="{first}", why="explanation", more="LEFT JOIN (SELECT src AS es, dst AS ed, explanation FROM expl) ON es = x.src AND ed = x.dst")


def shown(df):
    """Tags as one text, for comparison."""
    return df.withColumn("tags", F.array_join("tags", "|"))


def work_cards(t: Tables):
    return with_composers(t.works, t.composers, ["period"]).join(tags_of_works(t.tags), "work_id", "left").select(
        "work_id", "composer_id", "title", "work_type", "key", "period", "tags")


@query("f10_explain_similarity", "works composers tags", "SELECT src, dst, explanation FROM expl", {"pairs": """SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
 ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey"""} | SIM_SQL)
def _(t: Tables):
    from ostinato.plans.queries_similarity import bought_pairs

    return explain.explain_pairs(bought_pairs(t), t.cards, both_ways=True)


_LISTED = "[" + ", ".join(f"'{w}'" for w in CHARACTER_WORDS) + "]"
SEM_SQL = f""", g AS (SELECT work_id, list(tag ORDER BY tag) AS l FROM tags GROUP BY 1),
 q0 AS (SELECT list(activity ORDER BY activity) AS acts FROM (SELECT DISTINCT activity FROM query_log)),
 c0 AS (SELECT w.work_id, title, key AS pk, nullif(lower(work_type), '') AS wl, work_type AS wt, period, coalesce(l, CAST([] AS VARCHAR[])) AS l, acts[w.work_id % len(acts) + 1] AS query FROM works w
  LEFT JOIN composers c ON w.composer_id = c.composer_id LEFT JOIN g ON g.work_id = w.work_id CROSS JOIN q0),
 c1 AS (SELECT *, lower(query) AS ql, list_distinct(list_filter([pk], lambda x: x IS NOT NULL)) AS keys FROM c0),
 c2 AS (SELECT *, keys[1] AS k1, string_split({_moods_sql('keys[1]')}, ' ') AS m1 FROM c1),
 c3 AS (SELECT *, coalesce(contains(ql, lower(k1)), false) AS named, list_slice(list_filter(coalesce(m1, CAST([] AS VARCHAR[])), lambda m: m <> '' AND contains(ql, m)), 1, 2) AS hit,
  list_slice(list_filter(l, lambda x: contains(ql, lower(x))), 1, 2) AS tg, CASE WHEN contains(ql, lower(period)) THEN period END AS pd FROM c2),
 c4 AS (SELECT *, CASE WHEN named OR len(hit) > 0 THEN k1 END AS ek, CASE WHEN named THEN list_slice(m1, 1, 2) ELSE hit END AS em FROM c3),
 c5 AS (SELECT *, ek IS NOT NULL OR len(tg) > 0 OR pd IS NOT NULL AS exact,
  list_concat(CASE WHEN k1 IS NOT NULL THEN [concat(array_to_string(list_slice(m1, 1, 2), ' and '), ' (', k1, ')')] ELSE CAST([] AS VARCHAR[]) END,
   CASE WHEN len(list_filter(list_slice(l, 1, 5), lambda x: len(list_filter({_LISTED}, lambda w: contains(lower(x), w))) > 0)) > 0
    THEN list_slice(list_filter(list_slice(l, 1, 5), lambda x: len(list_filter({_LISTED}, lambda w: contains(lower(x), w))) > 0), 1, 2) ELSE list_slice(l, 1, 2) END) AS feats FROM c4),
 c6 AS (SELECT work_id, query, exact, CASE WHEN exact THEN ek END AS k, CASE WHEN exact THEN em ELSE CAST([] AS VARCHAR[]) END AS m, list_slice(CASE WHEN exact THEN tg ELSE feats END, 1, 3) AS tgs,
  CASE WHEN exact THEN pd ELSE period END AS p, CASE WHEN exact THEN wt WHEN len(feats) < 2 OR wl NOT IN ('symphony', 'concerto') THEN wl ELSE wt END AS w FROM c5),
 c7 AS (SELECT *, CASE len(tgs) WHEN 0 THEN '' WHEN 1 THEN tgs[1] WHEN 2 THEN concat(tgs[1], ' and ', tgs[2]) ELSE concat(tgs[1], ', ', tgs[2], ', and ', tgs[3]) END AS tt,
  CASE WHEN k IS NOT NULL THEN concat(CASE len(m) WHEN 0 THEN '' WHEN 1 THEN concat(m[1], ' ') ELSE concat(m[1], ' and ', m[2], ' ') END, 'in ', k) END AS ph,
  CASE WHEN list_contains(['a','e','i','o','u'], lower(substr(w, 1, 1))) THEN 'An' ELSE 'A' END AS art FROM c6),
 c8 AS (SELECT *, CASE WHEN tt <> '' THEN concat(' with ', tt, ' character') ELSE '' END AS wtags FROM c7)
SELECT work_id, query, CASE WHEN p IS NOT NULL AND w IS NOT NULL AND ph IS NOT NULL THEN concat(art, ' ', p, ' ', w, ' that''s ', ph, wtags)
 WHEN ph IS NOT NULL THEN concat(upper(substr(ph, 1, 1)), lower(substr(ph, 2)), wtags, CASE WHEN w IS NOT NULL THEN concat(', ', lower(art), ' ', w) ELSE '' END)
 WHEN tt <> '' AND p IS NOT NULL AND w IS NOT NULL THEN concat(art, ' ', p, ' ', w, wtags) WHEN tt <> '' THEN concat('Featuring ', tt, ' character')
 WHEN p IS NOT NULL AND w IS NOT NULL THEN concat(art, ' ', p, ' ', w, ' that matches your vibe') WHEN w IS NOT NULL THEN concat(art, ' ', w, ' that matches the mood you''re looking for')
 WHEN p IS NOT NULL THEN 'Recommended based on musical similarity to your search' ELSE 'A piece that matches the mood you''re looking for' END AS explanation FROM c8"""


#: The steps of SEM_SQL from rows ``c0`` on, and its sentence over the last of them.
SEM_STEPS, SEM_SENTENCE = SEM_SQL[SEM_SQL.index(" c1 AS ("):].rsplit("\nSELECT ", 1)
SEM_SENTENCE = "SELECT " + SEM_SENTENCE


@query("f11_explain_search", "works composers tags query_log", SEM_SQL)
def _(t: Tables):
    acts = t.query_log.select("activity").distinct().agg(F.array_sort(F.collect_set("activity")).alias("acts"))  # nine activities
    listed = acts.first()["acts"]
    rows = work_cards(t).withColumn("query", F.element_at(F.array(*map(F.lit, listed)), (F.col("work_id") % len(listed) + 1).cast("int")))
    return explain.explain_results(rows).select("work_id", "query", "explanation")


# --- embeddings and search -------------------------------------------------------------------------------

@query("v10_embed_documents", "", """SELECT id AS doc_id, 128 AS dim, CAST(len(list_filter(v, lambda x: abs(x) > 1e-9)) AS INT) AS cells, round(list_sum(list_transform(v, lambda x: x * x)), 3) AS length,
 round(list_sum(list_transform(v, lambda x, i: x * i)), 3) + 0.0 AS moment FROM hv""", hashed_sql("SELECT doc_id AS id, text AS txt FROM documents", 128))
def _(t: Tables):
    e = semantic.embed(t.documents, "doc_id", "text", dim=128).withColumn("v", F.col("embedding").cast("array<double>"))
    add = lambda col: F.aggregate(col, F.lit(0.0), lambda s, x: s + x)
    return e.select("doc_id", F.size("v").alias("dim"), F.size(F.filter("v", lambda x: F.abs(x) > 1e-9)).alias("cells"), F.round(add(F.transform("v", lambda x: x * x)), 3).alias("length"),
                    (F.round(add(F.transform("v", lambda x, i: x * (i + 1))), 3) + 0.0).alias("moment"))


def letter_encoder():
    """Tiny encoder plug-in: letter counts of each text."""
    def encode(texts):
        return [[float(x.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for x in texts]

    return encode


@query("x1_encoder_plugin", "", "SELECT doc_id, CAST(length(\"text\") - length(replace(lower(\"text\"), 'a', '')) AS DOUBLE) AS a, CAST(length(\"text\") - length(replace(lower(\"text\"), 'z', '')) AS DOUBLE) AS z FROM documents")
def _(t: Tables):
    e = semantic.embed(t.documents, "doc_id", "text", letter_encoder)
    return e.select("doc_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[25].cast("double").alias("z"))


@query("v11_embedding_search", "", "SELECT query_id, vec_id, score, rank FROM results", CENTROID_SQL)
def _(t: Tables):
    return centroid_results(t)


@query("v11_search_by_column", "", "SELECT vec_id, score, CAST(rank AS INT) AS rank FROM results WHERE query_id = 4", CENTROID_SQL)
def _(t: Tables):
    vector = centroids(t).filter("query_id = 4").first()["embedding"]  # one query vector
    return semantic.search_one(vector, t.embeddings)


@query("j12_best_query_per_item", "", "SELECT vec_id, query_id, score FROM scored QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, query_id) = 1", CENTROID_SQL)
def _(t: Tables):
    return semantic.best_query(t.embeddings, centroids(t))


@query("v12_sample_by_score", "", f""", pool AS (SELECT query_id, vec_id, score FROM scored WHERE score >= 0.15 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 30),
 drawn AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY -ln({draw_sql('query_id', 'vec_id')}) / greatest(score, 1e-12), vec_id) <= 10)
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM drawn""", CENTROID_SQL)
def _(t: Tables):
    valid = centroid_results(t, 30, 0.15).select("query_id", "vec_id", "score")  # the pool is three times the sample
    return rerank.sample_by_score(valid, 10, "query_id", "vec_id")


@query("v13_hybrid", "", """, s AS (SELECT label AS query_id, min(vec_id) AS seed FROM e GROUP BY 1),
 h AS (SELECT q.query_id, e.vec_id, round(0.7 * list_cosine_similarity(q.v, e.v) + 0.3 * list_cosine_similarity(sv.v, e.v), 6) AS score FROM q JOIN s ON q.query_id = s.query_id JOIN e sv ON sv.vec_id = s.seed CROSS JOIN e WHERE e.vec_id <> s.seed)
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM h QUALIFY rank <= 10""", CENTROID_SQL)
def _(t: Tables):
    seeds = t.embeddings.groupBy(F.col("label").alias("query_id")).agg(F.min("vec_id").alias("seed_id"))
    return semantic.hybrid(centroids(t).join(seeds, "query_id"), t.embeddings, 10, 0.7)


@query("e10_embedding_quality", "works composers tags", """, p AS (SELECT list_cosine_similarity(a.v, b.v) AS s, round(list_cosine_similarity(a.v, b.v), 6) AS r FROM e a JOIN e b ON a.vec_id < b.vec_id)
SELECT CAST((SELECT count(*) FROM e) AS BIGINT) AS num_works, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, min(r) AS min, max(r) AS max, round(median(r), 6) AS median,
 round(quantile_cont(r, 0.25), 6) AS q25, round(quantile_cont(r, 0.75), 6) AS q75 FROM p""", {"e": CENTROID_SQL["e"]})
def _(t: Tables):
    q = semantic.embedding_quality(t.embeddings, semantic.describe_works(t.works, t.composers, t.tags))
    return q.select("num_works", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max", "median", "q25", "q75")])


@query("e10_description_lengths", "", f"""SELECT round(avg(length(description)), 6) AS avg_length, CAST(min(length(description)) AS INT) AS min_length,
 CAST(max(length(description)) AS INT) AS max_length FROM ({ORACLES['f6_descriptions']})""")
def _(t: Tables):
    s = semantic.description_stats(semantic.describe_works(t.works, t.composers, t.tags))
    return s.withColumn("avg_length", F.round("avg_length", 6))


@query("a23_history_rows", "", """SELECT CAST(query_id AS VARCHAR) AS query, vec_id AS work_id, CAST(query_id AS VARCHAR) AS vibe, CAST(rank AS INT) AS rank, score AS relevance_score FROM results""", CENTROID_SQL)
def _(t: Tables):
    r = centroid_results(t).select(F.col("query_id").cast("string").alias("query"), F.col("vec_id").alias("work_id"), F.col("score").alias("relevance_score"))
    return interactions.history_rows(r, ["query"], [F.desc("relevance_score"), F.asc("work_id")])
