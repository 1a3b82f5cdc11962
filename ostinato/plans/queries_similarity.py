"""Queries: features, similarity and re-ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.functions.fixed_values import CATALOG_FLAGS
from ostinato.operators import features as ft
from ostinato.operators import neighbours, recommend, rerank, similarity
from ostinato.operators.catalog import first_per_type
from ostinato.plans.common import DOT_SQL, FEATURES_SQL, LISTS_SQL, draw_sql, embedding_edges
from ostinato.plans.queries_semantic import EXPLAINED_SQL, SIM_SQL, shown
from ostinato.plans.registry import query
from ostinato.plans.views import Tables, _re2

W, WC, WCG = "works", "works composers", "works composers tags"
ALL = FEATURES_SQL


def bought_pairs(t: Tables):
    """Distinct pairs ``src < dst`` of works of one order, which has few lines; dealt by the first work, as their uses want them.

    Each stands for both directions (``both_ways`` of the uses), so that half the pairs are moved and joined.
    """
    li = t.base("lineitem").select("l_orderkey", F.col("l_partkey").alias("src"))
    other = t.base("lineitem").select("l_orderkey", F.col("l_partkey").alias("dst"))
    return li.join(other, "l_orderkey").filter("src < dst").select("src", "dst").repartition("src").distinct()


PAIRS_SQL = {"pairs": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey"}


@query("v1_one_hot", WC, """, p AS (SELECT work_id, coalesce(name, 'unknown') AS name, coalesce(period, 'unknown') AS period, coalesce(work_type, 'unknown') AS work_type, coalesce(country, 'unknown') AS country
 FROM works w LEFT JOIN composers c ON w.composer_id = c.composer_id)
SELECT work_id, concat('composer_', name) AS feature, 1.0::DOUBLE AS value FROM p UNION ALL SELECT work_id, concat('period_', period), 1.0 FROM p
UNION ALL SELECT work_id, concat('work_type_', work_type), 1.0 FROM p UNION ALL SELECT work_id, concat('country_', country), 1.0 FROM p""")
def _(t: Tables):
    p = ft.prepare(t.works, t.composers)
    parts = [ft.one_hot(p, g) for g in ft.GROUPS]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("v1_categories", WC, """SELECT concat('period_', p) AS feature, CAST(row_number() OVER (ORDER BY p) - 1 AS INT) AS position FROM
 (SELECT DISTINCT coalesce(period, 'unknown') AS p FROM works w LEFT JOIN composers c ON w.composer_id = c.composer_id)""")
def _(t: Tables):
    return ft.one_hot_categories(ft.prepare(t.works, t.composers), "period")


@query("v2_key_circle", WCG, "SELECT work_id, round(coalesce(sin(2 * pi() * pos / 12), 0.0), 6) + 0.0 AS key_sin, round(coalesce(cos(2 * pi() * pos / 12), 0.0), 6) + 0.0 AS key_cos FROM feat", ALL)
def _(t: Tables):
    s, c = ft.key_vector(F.col("key"))
    return t.works.select("work_id", (F.round(s, 6) + 0.0).alias("key_sin"), (F.round(c, 6) + 0.0).alias("key_cos"))


@query("v3_tag_tfidf", WCG, "SELECT work_id, term, round(weight, 6) AS weight FROM tfidf", ALL)
def _(t: Tables):
    vectors, vocabulary = ft.tag_tfidf(t.works, t.tags)
    return ft.tags_long(vectors, vocabulary).withColumn("weight", F.round("weight", 6))


@query("v3_vocabulary", WCG, "SELECT term, CAST(term_id AS INT) AS term_id, round(idf, 6) AS idf FROM vocab", ALL)
def _(t: Tables):
    return ft.tag_tfidf(t.works, t.tags)[1].withColumn("idf", F.round("idf", 6))


@query("v4_catalog_flags", W, "SELECT work_id, CAST(" + " + ".join(
    f"CASE WHEN regexp_matches(coalesce(catalog_number, ''), '{_re2(p)}', 'i') THEN {1 << i} ELSE 0 END" for i, p in enumerate(CATALOG_FLAGS.values())) + " AS INT) AS flags FROM works")
def _(t: Tables):
    return t.works.select("work_id", ft.catalog_flags(F.coalesce("catalog_number", F.lit(""))).alias("flags"))


@query("v4_composites", WCG, "SELECT work_id, concat(period, '_', work_type) AS a, concat(period, '_', key) AS b, round(n2, 6) AS norm2 FROM featn", ALL)
def _(t: Tables):
    return t.features.select("work_id", ft.composite("period", "work_type").alias("a"), ft.composite("period", "key").alias("b"), F.round("norm2", 6).alias("norm2"))


@query("v5_pair_scores", WCG, f""", s AS (SELECT src, dst, {DOT_SQL} AS d, a.n2 AS na, b.n2 AS nb FROM pairs JOIN featn a ON a.work_id = src JOIN featn b ON b.work_id = dst)
SELECT src, dst, round(d / sqrt(na * nb), 6) + 0.0 AS cosine, round(1 / (1 + sqrt(greatest(round(na + nb - 2 * d, 9), 0.0))), 6) AS euclidean, round(d, 6) + 0.0 AS dot FROM s""", ALL | PAIRS_SQL)
def _(t: Tables):
    return similarity.score_pairs(bought_pairs(t), t.features, ["cosine", "euclidean", "dot"], both_ways=True)


L1_SQL = """10.0 * CAST(a.name <> b.name AS INT) + 6.0 * CAST(a.period <> b.period AS INT) + 4.0 * CAST(a.work_type <> b.work_type AS INT) + 3.0 * CAST(a.country <> b.country AS INT)
 + 5.0 * (CAST(NOT (a.period = b.period AND a.work_type = b.work_type) AS INT) + CAST(NOT (a.period = b.period AND a.key = b.key) AS INT))
 + abs(coalesce(sin(2 * pi() * a.pos / 12), 0) - coalesce(sin(2 * pi() * b.pos / 12), 0)) + abs(coalesce(cos(2 * pi() * a.pos / 12), 0) - coalesce(cos(2 * pi() * b.pos / 12), 0))
 + 2.5 * list_sum(list_transform(a.vec, lambda x, i: abs(x - b.vec[i]))) + 0.5 * bit_count(xor(a.flag, b.flag))"""


@query("v5_manhattan", WCG, f"SELECT src, dst, round(1 / (1 + {L1_SQL}), 6) AS manhattan FROM pairs JOIN featn a ON a.work_id = src JOIN featn b ON b.work_id = dst", ALL | PAIRS_SQL)
def _(t: Tables):
    return similarity.score_pairs(bought_pairs(t), t.features, ["manhattan"], both_ways=True)


@query("v6_top_edges", WCG, f"""SELECT a.work_id AS src, b.work_id AS dst, round({DOT_SQL.replace(chr(10), ' ')}, 12) AS d, round(({DOT_SQL}) / sqrt(a.n2 * b.n2), 6) AS score,
 CAST(row_number() OVER (PARTITION BY a.work_id ORDER BY round(({DOT_SQL}) / sqrt(a.n2 * b.n2), 6) DESC, b.work_id) AS INT) AS rank
 FROM featn a JOIN featn b ON a.work_id <> b.work_id QUALIFY rank <= 10""".replace(f"round({DOT_SQL.replace(chr(10), ' ')}, 12) AS d, ", ""), ALL)
def _(t: Tables):
    return similarity.all_edges(t.features, 10)


SEED_SQL = f"""SELECT work_id, score, CAST(row_number() OVER (ORDER BY score DESC, work_id) AS INT) AS rank FROM (SELECT b.work_id, round(({DOT_SQL}) / sqrt(a.n2 * b.n2), 6) AS score
 FROM featn a JOIN featn b ON a.work_id <> b.work_id WHERE a.work_id = {{seed}}) ORDER BY score DESC, work_id LIMIT 10"""


SEED = "SELECT {seed} AS src, work_id AS dst, score, rank FROM ({sql})"
TITLE_SEED = "(SELECT min(work_id) FROM works WHERE contains(lower(title), 'nocturne in g'))"


@query("v7_similar", WCG, EXPLAINED_SQL.format(first=""), ALL | {"pairs": SEED.format(seed=42, sql=SEED_SQL.format(seed=42))} | SIM_SQL)
def _(t: Tables):
    return shown(recommend.similar(t.features, t.cards, 42))


@query("v8_similar_to_title", WCG, EXPLAINED_SQL.format(first=""), ALL | {"pairs": SEED.format(seed=TITLE_SEED, sql=SEED_SQL.format(seed=TITLE_SEED))} | SIM_SQL)
def _(t: Tables):
    return shown(recommend.similar_to_title(t.features, t.cards, "Nocturne in G"))


def _greedy_sql(rounds: int, weight: float = 0.3) -> tuple[dict[str, str], str]:
    """The greedy rounds spelled out, one state table and one pick table per round."""
    sim = f"({DOT_SQL}) / sqrt(a.n2 * b.n2)"
    ctes = {
        "seeds": "SELECT min(work_id) AS seed FROM works WHERE work_type IS NOT NULL GROUP BY work_type",
        "st1": f"SELECT seed, b.work_id AS cand, {sim} AS rel, CAST(NULL AS DOUBLE) AS red FROM seeds JOIN featn a ON a.work_id = seed JOIN featn b ON b.work_id <> seed",
    }
    for r in range(1, rounds + 1):
        ctes[f"pk{r}"] = (f"SELECT seed, cand AS pick, rel FROM st{r} QUALIFY row_number() OVER (PARTITION BY seed ORDER BY "
                          f"round({weight} * rel - {1 - weight} * coalesce(red, 0.0), 6) DESC, cand) = 1")
        ctes[f"st{r + 1}"] = (f"SELECT s.seed, cand, s.rel, greatest(coalesce(red, -1e9), {sim}) AS red FROM st{r} s JOIN pk{r} p ON p.seed = s.seed AND p.pick <> s.cand "
                              "JOIN featn a ON a.work_id = p.pick JOIN featn b ON b.work_id = s.cand")
    del ctes[f"st{rounds + 1}"]
    return ctes, " UNION ALL ".join(f"SELECT seed AS seed_id, pick AS item_id, round(rel, 6) AS score, {r} AS rank FROM pk{r}" for r in range(1, rounds + 1))


_CTES, _BODY = _greedy_sql(10)


@query("v9_diverse", WCG, _BODY, ALL | _CTES)
def _(t: Tables):
    return rerank.diverse(t.features, first_per_type(t.works).select("work_id"), 10)


@query("v9_diverse_rows", WCG, EXPLAINED_SQL.format(first="x.src AS seed_id, "), ALL | _CTES | {"pairs": f"SELECT seed_id AS src, item_id AS dst, score, rank FROM ({_BODY})"} | SIM_SQL)
def _(t: Tables):
    return shown(recommend.diverse(t.features, t.cards, first_per_type(t.works).select("work_id"), 10))


def _greedy_vectors_sql(rounds: int, weight: float) -> tuple[dict[str, str], str]:
    """The greedy rounds over embeddings, from the first vector of each label."""
    def sim(a, b):
        return f"list_cosine_similarity({a}.v, {b}.v)"

    ctes = {
        "e": LISTS_SQL["e"],
        "st1": f"SELECT s.seed, b.vec_id AS cand, {sim('a', 'b')} AS rel, CAST(NULL AS DOUBLE) AS red FROM (SELECT min(vec_id) AS seed FROM e GROUP BY label) s JOIN e a ON a.vec_id = s.seed JOIN e b ON b.vec_id <> s.seed",
    }
    for r in range(1, rounds + 1):
        ctes[f"pk{r}"] = (f"SELECT seed, cand AS pick, rel FROM st{r} QUALIFY row_number() OVER (PARTITION BY seed ORDER BY "
                          f"round({weight} * rel - {1 - weight} * coalesce(red, 0.0), 6) DESC, cand) = 1")
        ctes[f"st{r + 1}"] = (f"SELECT s.seed, cand, s.rel, greatest(coalesce(red, -1e9), {sim('a', 'b')}) AS red FROM st{r} s JOIN pk{r} p ON p.seed = s.seed AND p.pick <> s.cand "
                              "JOIN e a ON a.vec_id = p.pick JOIN e b ON b.vec_id = s.cand")
    del ctes[f"st{rounds + 1}"]
    return ctes, " UNION ALL ".join(f"SELECT seed AS seed_id, pick AS item_id, round(rel, 6) AS score, {r} AS rank FROM pk{r}" for r in range(1, rounds + 1))


_VCTES, _VBODY = _greedy_vectors_sql(5, 0.75)


@query("x3_greedy_reranker", "", _VBODY, _VCTES)
def _(t: Tables):
    from ostinato.operators.blocks import cosine_block

    seeds = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    return rerank.diverse(t.embeddings.select("vec_id", "embedding"), seeds, 5, 0.75, cosine_block("embedding"), "vec_id")


def _near_sql(tables: int = 4, probes: int = 3, bucket: int = 256, k: int = 10) -> dict[str, str]:
    """The hashes, probes and sketches of the approximate search, spelled out; buckets above the cap do not occur here."""
    bit = "(CAST('0x' || substr(md5(concat(d, ':', j // 128)), CAST(1 + (j % 128) // 4 AS INT), 1) AS INT) >> CAST(3 - j % 4 AS INT)) & 1"
    own = f"CAST(list_sum(list_transform(range(bits), lambda i: (CASE WHEN p[t * bits + i + 1] > 0 THEN 1 ELSE 0 END) << CAST(i AS INT))) AS BIGINT)"
    doubt = f"list_transform(list_slice(list_sort(list_transform(range(bits), lambda i: {{'m': abs(p[t * bits + i + 1]), 'i': i}})), 1, {probes - 1}), lambda x: x.i)"
    return {
        "e": LISTS_SQL["e"],
        "sizes": f"""SELECT n, dims, bits, CASE WHEN bits > 0 THEN {tables} ELSE 1 END AS tables FROM (SELECT count(*) AS n, max(len(v)) AS dims,
 CASE WHEN count(*) > {bucket} THEN CAST(floor(log2(count(*) / {bucket})) AS BIGINT) ELSE 0 END AS bits FROM e)""",
        "proj": f"SELECT j, list(2 * ({bit}) - 1 ORDER BY d) AS r FROM (SELECT unnest(range(dims)) AS d FROM sizes), (SELECT unnest(range(tables * bits + 1024)) AS j FROM sizes) GROUP BY j",
        "steps": "SELECT vec_id, list_transform(v, lambda x: floor(x / m * 1048576 + 0.5)) AS q FROM (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS m FROM e)",
        "projected": "SELECT vec_id, list(list_inner_product(q, CAST(r AS DOUBLE[])) ORDER BY j) AS p FROM steps, proj GROUP BY vec_id",
        "sketch": """SELECT vec_id, CAST(array_to_string(list_transform(list_slice(p, tables * bits + 1, tables * bits + 1024), lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS BIT) AS s
 FROM projected, sizes""",
        "keyed": f"SELECT vec_id, t, key, doubt FROM (SELECT vec_id, t, coalesce({own}, 0) AS key, coalesce({doubt}, []) AS doubt FROM projected, sizes, (SELECT unnest(range(tables)) AS t FROM sizes))",
        "asked": "SELECT vec_id, t, unnest(list_concat([key], list_transform(doubt, lambda i: xor(key, CAST(1 AS BIGINT) << CAST(i AS INT))))) AS key FROM keyed",
        "met": "SELECT DISTINCT a.vec_id AS src, b.vec_id AS dst FROM asked a JOIN keyed b ON a.t = b.t AND a.key = b.key AND a.vec_id <> b.vec_id",
        "smp": "SELECT s FROM sketch ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 1024",
        "lim": f"SELECT vec_id, list_sort(list(bit_count(xor(a.s, b.s))))[least({4 * k}, count(*))] AS h FROM sketch a, smp b GROUP BY vec_id",
        "near": f"""SELECT src, dst, round(list_cosine_similarity(ea.v, eb.v), 6) AS score FROM met JOIN sketch a ON a.vec_id = src JOIN sketch b ON b.vec_id = dst JOIN lim ON lim.vec_id = src
 JOIN e ea ON ea.vec_id = src JOIN e eb ON eb.vec_id = dst WHERE bit_count(xor(a.s, b.s)) <= h""",
        "approx": f"SELECT src, dst, score, CAST(row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS INT) AS rank FROM near QUALIFY rank <= {k}",
    }


NEAR_SQL = _near_sql()


@query("v14_approximate_neighbours", "", "SELECT src, dst, score, rank FROM approx", NEAR_SQL)
def _(t: Tables):
    return neighbours.neighbours(t.embeddings, 10)


@query("v14_recall", "", """, exact AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM e a JOIN e b ON a.vec_id <> b.vec_id
 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.vec_id) <= 10)
SELECT count(*) AS edges, count(p.src) AS found, round(count(p.src) / greatest(count(*), 1), 6) AS recall, round((SELECT count(*) FROM met) / max(n * (n - 1.0)), 6) AS met_share,
 round((SELECT count(*) FROM near) / max(n * (n - 1.0)), 6) AS scored_share FROM exact x LEFT JOIN approx p ON x.src = p.src AND x.dst = p.dst, sizes""", NEAR_SQL)
def _(t: Tables):
    exact = embedding_edges(t).select(F.col("list_id").alias("src"), F.col("work_id").alias("dst"))
    return neighbours.recall(t.embeddings, exact, 10)


@query("v15_group_ranges", WCG, """SELECT 'composer' AS feature_group, CAST(count(DISTINCT name) AS BIGINT) AS n_features FROM feat UNION ALL SELECT 'period', count(DISTINCT period) FROM feat
 UNION ALL SELECT 'work_type', count(DISTINCT work_type) FROM feat UNION ALL SELECT 'country', count(DISTINCT country) FROM feat
 UNION ALL SELECT 'composite', count(DISTINCT concat(period, '_', work_type)) + count(DISTINCT concat(period, '_', key)) FROM feat
 UNION ALL SELECT 'key', 2 UNION ALL SELECT 'catalog', 8 UNION ALL SELECT 'tags', count(*) FROM vocab""", ALL)
def _(t: Tables):
    vocabulary = ft.tag_tfidf(t.works, t.tags)[1]
    return ft.group_ranges(t.works, t.composers, vocabulary)


@query("v15_feature_group", WCG, "SELECT work_id, concat('tag_', term) AS feature, round(2.5 * weight, 6) AS value FROM tfidf", ALL)
def _(t: Tables):
    vocabulary = ft.tag_tfidf(t.works, t.tags)[1]
    return ft.feature_group(t.features, "tags", vocabulary).withColumn("value", F.round("value", 6))


@query("x4_custom_metric", WCG, "SELECT src, dst, round((CAST(a.name = b.name AS INT) + CAST(a.key = b.key AS INT)) / 2.0, 6) AS shared_facts FROM pairs JOIN featn a ON a.work_id = src JOIN featn b ON b.work_id = dst", ALL | PAIRS_SQL)
def _(t: Tables):
    def shared_facts(a, b, _w):
        return (F.when(a("name") == b("name"), 1.0).otherwise(0.0) + F.when(a("key") == b("key"), 1.0).otherwise(0.0)) / 2

    similarity.register_metric("shared_facts", shared_facts)
    return similarity.score_pairs(bought_pairs(t), t.features, ["shared_facts"], both_ways=True)


# --- top-k over embeddings ------------------------------------------------------------------------------------

@query("t2_top_per_seed", WC, "SELECT list_id, work_id, score, rank FROM lists", LISTS_SQL)
def _(t: Tables):
    return embedding_edges(t)


@query("t1_top_pairs_of_catalog", WC, "SELECT list_id, work_id, score FROM lists ORDER BY score DESC, list_id, work_id LIMIT 20", LISTS_SQL)
def _(t: Tables):
    return embedding_edges(t).select("list_id", "work_id", "score").orderBy(F.desc("score"), "list_id", "work_id").limit(20)


@query("t5_pick_one", WC, f"SELECT list_id, work_id, score, rank FROM lists WHERE rank <= 5 QUALIFY row_number() OVER (PARTITION BY list_id ORDER BY {draw_sql('list_id', 'work_id')}, work_id) = 1", LISTS_SQL)
def _(t: Tables):
    return rerank.pick_one_per(embedding_edges(t), "list_id")


@query("t6_sample_works", W, f"SELECT work_id, title FROM works WHERE composer_id IS NOT NULL ORDER BY {draw_sql('work_id')}, work_id LIMIT 100")
def _(t: Tables):
    return rerank.sample_works(t.works, 100, with_composer=True).select("work_id", "title")
