"""Derived tables shared by the queries: corrections, decisions, recommendation lists, results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.operators import corrections
from ostinato.operators.catalog import with_composers
from ostinato.operators.features import feature_rows, tag_tfidf
from ostinato.operators.semantic import search
from ostinato.plans.views import Tables
from ostinato.session import cut

# --- draws: the same numbers in both engines ------------------------------------------------------------------

def draw_sql(*cols: str, seed: int | str = 42) -> str:
    """The number in (0, 1) of ``rerank.uniform`` for the checking engine."""
    return f"((CAST('0x' || substr(md5(concat_ws('|', {', '.join(cols)}, {seed})), 1, 13) AS BIGINT) + 0.5) / 4503599627370496)"


# --- edits: the tagger's tags against all tags without two words -----------------------------------------

OLD_NEW_SQL = {
    "old_new": """SELECT o.work_id, old_tags, new_tags FROM
 (SELECT work_id, list(tag ORDER BY tag) AS old_tags FROM tags WHERE source = 'auto-tagger' GROUP BY 1) o
 LEFT JOIN (SELECT work_id, list(DISTINCT tag ORDER BY tag) AS new_tags FROM tags WHERE tag NOT IN ('romantic', 'ring') GROUP BY 1) n ON o.work_id = n.work_id"""
}
CORRECTIONS_SQL = {
    "corrections": """SELECT w.work_id, title, composer_id, work_type, key,
 list_sort(list_filter(list_distinct(old_tags), lambda x: NOT list_contains(coalesce(new_tags, []), x))) AS removed,
 list_sort(list_filter(list_distinct(coalesce(new_tags, [])), lambda x: NOT list_contains(old_tags, x))) AS added,
 'human' AS reviewer, concat('2024-01-', lpad(CAST(w.work_id % 28 + 1 AS VARCHAR), 2, '0')) AS "timestamp"
 FROM old_new o JOIN works w ON o.work_id = w.work_id"""
}


def edits(t: Tables) -> DataFrame:
    def lists(df, name):
        return df.groupBy("work_id").agg(F.array_sort(F.collect_list("tag")).alias(name))

    old = lists(t.tags.filter("source = 'auto-tagger'"), "old_tags")
    new = lists(t.tags.filter("tag NOT IN ('romantic', 'ring')").select("work_id", "tag").distinct(), "new_tags")
    empty = F.array().cast("array<string>")
    return old.join(new, "work_id", "left").withColumn("new_tags", F.coalesce("new_tags", empty)).withColumn("reason", F.lit("checked"))


def derived_corrections(t: Tables) -> DataFrame:
    at = F.concat(F.lit("2024-01-"), F.lpad((F.col("work_id") % 28 + 1).cast("string"), 2, "0"))
    return corrections.capture(t.works, edits(t), at=at)


# --- review decisions by catalogue number kind -------------------------------------------------------------

DECISIONS_SQL = {
    "decisions": """SELECT w.work_id, CASE WHEN catalog_number IS NULL THEN 'rejected' WHEN work_type IS NULL THEN 'skipped'
 WHEN work_type = 'Sonata' THEN 'corrected' ELSE 'approved' END AS decision, new_tags FROM works w JOIN old_new o ON w.work_id = o.work_id"""
}


def decisions(t: Tables) -> DataFrame:
    kind = (
        F.when(F.col("catalog_number").isNull(), "rejected").when(F.col("work_type").isNull(), "skipped")
        .when(F.col("work_type") == "Sonata", "corrected").otherwise("approved"))
    return t.works.join(edits(t), "work_id").select("work_id", kind.alias("decision"), "new_tags")


# --- content features ------------------------------------------------------------------------------------------

def content(t: Tables, store: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feature rows, TF-IDF vectors and vocabulary; rows are stored, as most uses read them more than once."""
    vectors, vocabulary = tag_tfidf(t.works, t.tags)
    rows = feature_rows(t.works, t.composers, vectors)
    return (cut(rows, "features") if store else rows), vectors, vocabulary


# The same features for the checking engine: dense TF-IDF lists over the vocabulary
FEATURES_SQL = {
    "docs": """SELECT w.work_id, coalesce(lower(string_agg(tag, ' ' ORDER BY tag, source)), 'no_tags') AS doc
 FROM works w LEFT JOIN tags t ON w.work_id = t.work_id GROUP BY 1""",
    "words": r"SELECT work_id, regexp_extract_all(doc, '\w+') AS ws FROM docs",
    "grams": """SELECT work_id, unnest(list_concat(ws, list_transform(list_slice(ws, 1, len(ws) - 1), lambda x, i: concat(x, ' ', ws[i + 1])))) AS term FROM words""",
    "tf": "SELECT work_id, term, count(*) AS tf FROM grams GROUP BY 1, 2",
    "vocab": """SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, ln((1 + (SELECT count(*) FROM works)) / (1.0 + df)) + 1 AS idf
 FROM (SELECT term, sum(tf) AS ctf, count(*) AS df FROM tf GROUP BY 1 ORDER BY ctf DESC, term LIMIT 100)""",
    "raww": "SELECT work_id, term, term_id, tf * idf AS x FROM tf JOIN vocab USING (term)",
    "tfidf": "SELECT work_id, term, term_id, x / sqrt(sum(x * x) OVER (PARTITION BY work_id)) AS weight FROM raww",
    "dense": """SELECT w.work_id, list(coalesce(weight, 0.0) ORDER BY v.term_id) AS vec, max(CASE WHEN weight IS NOT NULL THEN 1 ELSE 0 END) AS has_terms
 FROM works w CROSS JOIN vocab v LEFT JOIN tfidf t ON t.work_id = w.work_id AND t.term_id = v.term_id GROUP BY 1""",
    "feat": """SELECT w.work_id, coalesce(name, 'unknown') AS name, coalesce(period, 'unknown') AS period, coalesce(country, 'unknown') AS country,
 coalesce(work_type, 'unknown') AS work_type, coalesce(key, 'unknown') AS key,
 CASE key WHEN 'C major' THEN 0 WHEN 'G major' THEN 1 WHEN 'D major' THEN 2 WHEN 'A major' THEN 3 WHEN 'E major' THEN 4 WHEN 'B major' THEN 5
  WHEN 'F major' THEN 11 WHEN 'A minor' THEN 0 WHEN 'E minor' THEN 1 WHEN 'B minor' THEN 2 WHEN 'F minor' THEN 8 WHEN 'C minor' THEN 9
  WHEN 'G minor' THEN 10 WHEN 'D minor' THEN 11 END AS pos, vec, has_terms,
 CASE WHEN regexp_matches(catalog_number, '^Op') THEN 1 WHEN regexp_matches(catalog_number, '^BWV') THEN 2
  WHEN regexp_matches(catalog_number, '^K') THEN 4 WHEN regexp_matches(catalog_number, '^RV') THEN 8 ELSE 0 END AS flag
 FROM works w LEFT JOIN composers c ON w.composer_id = c.composer_id JOIN dense d ON d.work_id = w.work_id""",
    "featn": """SELECT *, 52.75 + CASE WHEN pos IS NOT NULL THEN 1.0 ELSE 0.0 END + 6.25 * has_terms + CASE WHEN flag > 0 THEN 0.25 ELSE 0.0 END AS n2 FROM feat""",
}
DOT_SQL = """25.0 * CAST(a.name = b.name AS INT) + 9.0 * CAST(a.period = b.period AS INT) + 4.0 * CAST(a.work_type = b.work_type AS INT)
 + 2.25 * CAST(a.country = b.country AS INT) + 6.25 * (CAST(a.period = b.period AND a.work_type = b.work_type AS INT) + CAST(a.period = b.period AND a.key = b.key AS INT))
 + coalesce(cos(2 * pi() * (a.pos - b.pos) / 12), 0.0) + 6.25 * list_inner_product(a.vec, b.vec) + 0.25 * CAST(a.flag = b.flag AND a.flag > 0 AS INT)"""

# --- embedding lists: every vector is a seed -----------------------------------------------------------------------

LISTS_SQL = {
    "e": "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings",
    "lists": """SELECT list_id, r.work_id, score, CAST(rank AS INT) AS rank, composer, work_type, period, key FROM
 (SELECT a.vec_id AS list_id, b.vec_id AS work_id, CAST(b.label AS VARCHAR) AS composer, round(list_cosine_similarity(a.v, b.v), 6) AS score,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.vec_id) AS rank
  FROM e a JOIN e b ON a.vec_id <> b.vec_id QUALIFY rank <= 10) r
 LEFT JOIN works w ON w.work_id = r.work_id LEFT JOIN composers c ON c.composer_id = w.composer_id""",
}


def embedding_edges(t: Tables, k: int = 10) -> DataFrame:
    """Top k other vectors of every vector: ``(list_id, work_id, score, rank)``."""
    e = t.embeddings.select("vec_id", "embedding")
    q = e.withColumnRenamed("vec_id", "list_id")
    from ostinato.operators.blocks import cosine_block, top_items
    import numpy as np

    cos = cosine_block("embedding")

    def score(a, b):
        return np.where(a["list_id"].to_numpy()[:, None] == b["vec_id"].to_numpy()[None, :], -np.inf, cos(a, b))

    return top_items(q, e, k, score, "list_id", "vec_id").withColumnRenamed("vec_id", "work_id")


def embedding_lists(t: Tables, k: int = 10) -> DataFrame:
    """Lists with metadata: the label is the composer, type, key and period come from the works."""
    meta = with_composers(t.works, t.composers, ["period"]).select("work_id", "work_type", "key", "period")
    labels = t.embeddings.select(F.col("vec_id").alias("work_id"), F.col("label").cast("string").alias("composer"))
    return embedding_edges(t, k).join(labels, "work_id").join(meta, "work_id", "left")


# --- searches: the mean vector of each label is a query ----------------------------------------------------------------

CENTROID_SQL = {
    "e": "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings",
    "cells": "SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e",
    "q": "SELECT label AS query_id, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM cells GROUP BY 1, 2) GROUP BY 1",
    "scored": "SELECT q.query_id, e.vec_id, label, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM q CROSS JOIN e",
    "results": """SELECT query_id, vec_id, label, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank
 FROM scored WHERE score >= 0.15 QUALIFY rank <= 10""",
}


def centroids(t: Tables) -> DataFrame:
    """One query per label: the mean of its vectors."""
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = cells.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))  # one entry per dimension
    return packed.select(F.col("label").alias("query_id"), F.transform("c", lambda x: x["m"]).alias("embedding"))


def centroid_results(t: Tables, n: int = 10, min_score: float | None = 0.15) -> DataFrame:
    return search(centroids(t), t.embeddings, n, min_score)


# --- texts as hashed vectors ---------------------------------------------------------------------------------------------

def hashed_sql(source: str, dim: int) -> dict[str, str]:
    """``hv(id, v)``: the built-in encoder over the rows (id, txt) of ``source``."""
    return {
        "tok": f"SELECT id, unnest(regexp_extract_all(lower(txt), '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+')) AS w FROM ({source})",
        "tfs": "SELECT id, w, count(*) AS tf FROM tok GROUP BY 1, 2",
        "hcell": f"""SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {dim} AS i, sum((CASE WHEN CAST('0x' || substr(md5(w), 9, 1) AS INT) % 2 = 0 THEN 1.0 ELSE -1.0 END)
 * (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM ({source}))) / (1.0 + df)) + 1)) AS x FROM tfs JOIN (SELECT w, count(*) AS df FROM tfs GROUP BY 1) USING (w) GROUP BY 1, 2""",
        "hv": f"""SELECT id, list(CAST(CAST(coalesce(x / nullif(n, 0), 0) AS FLOAT) AS DOUBLE) ORDER BY k.i) AS v FROM (SELECT id, unnest(range({dim})) AS i FROM ({source})) k LEFT JOIN hcell USING (id, i)
 LEFT JOIN (SELECT id, sqrt(sum(x * x)) AS n FROM hcell GROUP BY 1) USING (id) GROUP BY id""",
    }
