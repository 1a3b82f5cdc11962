"""Evaluation of recommendation lists and searches.

A list table has one row per recommendation: ``list_id, work_id, score, rank`` and the metadata
``composer, work_type, period, key, tags`` where an operator needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ostinato.functions.fixed_values import EXPECTATION_CASES, MOOD_QUERIES
from ostinato.operators.rerank import uniform
from ostinato.operators.shape import long_metrics, one_row
from ostinato.operators.tags import unite


def gini(values: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Gini coefficient of positive counts, over all rows or per key.

    Works on the counts of distinct values: these number at most about sqrt(2 * sum) per group, so
    the ordered pass stays small when a group holds very many rows.
    """
    keys = keys or []
    h = values.groupBy(*keys, F.col(value).alias("x")).agg(F.count("*").alias("m"))
    w = Window.partitionBy(*keys).orderBy("x")
    upto = F.sum("m").over(w)
    # ranks of the m equal values are upto - m + 1 .. upto
    rows = h.withColumn("rank_sum", F.col("m") * (2 * upto - F.col("m") + 1) / 2)
    a = rows.groupBy(*keys).agg(
        F.sum("m").alias("n"), F.sum(F.col("m") * F.col("x")).alias("total"), F.sum(F.col("rank_sum") * F.col("x")).alias("ix"))
    g = 2 * F.col("ix") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")
    return a.select(*keys, "n", F.when(F.col("n") == 0, 0.0).otherwise(g).alias("gini"))


def list_diversity(lists: DataFrame) -> DataFrame:
    """Per list: unique ratios, largest composer share, Gini of composer counts, mean score difference of pairs."""
    per_composer = lists.groupBy("list_id", "composer").agg(F.count("*").alias("c"))
    comp = per_composer.groupBy("list_id").agg(F.count("*").alias("composers"), F.max("c").alias("top"))
    g = gini(per_composer, "c", ["list_id"]).select("list_id", F.col("gini").alias("gini_coefficient"))
    place = F.row_number().over(Window.partitionBy("list_id").orderBy("score"))
    per_list = lists.withColumn("_i", place).groupBy("list_id").agg(
        F.count("*").alias("n"),
        F.count_distinct("work_type").alias("t"), F.count("work_type").alias("tn"),
        F.count_distinct("period").alias("p"), F.count("period").alias("pn"),
        F.sum(F.col("_i") * F.col("score")).alias("ix"), F.sum("score").alias("s"))
    n = F.col("n")
    pairs = F.when(n > 1, 2 * (2 * F.col("ix") - (n + 1) * F.col("s")) / (n * (n - 1))).otherwise(F.lit(0.0))

    def ratio(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return per_list.join(comp, "list_id").join(g, "list_id").select(
        "list_id", pairs.alias("avg_pairwise_dissimilarity"), (F.col("composers") / n).alias("unique_composers_ratio"),
        ratio("t", "tn").alias("unique_work_types_ratio"), ratio("p", "pn").alias("unique_periods_ratio"),
        (F.col("top") / n).alias("max_same_composer_ratio"), "gini_coefficient")


def catalog_coverage(lists: DataFrame, works: DataFrame, composers: DataFrame) -> DataFrame:
    """One row: works ever recommended and their share, categories covered, recommendations per work."""
    per_work = lists.groupBy("work_id").agg(F.count("*").alias("n"))
    w = per_work.agg(
        F.count("*").alias("works_ever_recommended"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_recommendations_per_work"),
        F.coalesce(F.median("n"), F.lit(0.0)).alias("median_recommendations_per_work"))
    seen = lists.agg(
        F.count_distinct("composer").alias("composers_covered"), F.count_distinct("work_type").alias("work_types_covered"),
        F.count_distinct("period").alias("periods_covered"))
    cat = works.agg(F.count("*").alias("total_catalog_size"), F.count_distinct("work_type").alias("work_types_total"))
    comp = composers.agg(F.count_distinct("name").alias("composers_total"), F.count_distinct("period").alias("periods_total"))
    row = one_row(w, seen, cat, comp)
    return row.withColumn("coverage_ratio", F.col("works_ever_recommended") / F.col("total_catalog_size"))


def most_recommended(lists: DataFrame, n: int = 10) -> DataFrame:
    return lists.groupBy("work_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "work_id").limit(n)


def score_distribution(lists: DataFrame, score: str = "score") -> DataFrame:
    """One row: mean, median, population std, min, max, quartiles, n (scores hold six digits, so few distinct)."""
    s = F.col(score)
    return lists.agg(
        F.avg(s).alias("mean"), F.median(s).alias("median"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"),
        F.max(s).alias("max"), F.percentile(s, 0.25).alias("q25"), F.percentile(s, 0.75).alias("q75"), F.count("*").alias("n_samples"))


def case_table(spark) -> DataFrame:
    return spark.createDataFrame(
        EXPECTATION_CASES, "name string, seed_query string, must_type string, max_same_composer int, min_score double"
    ).withColumn("must_composer", F.lit(None).cast("string"))


def check_cases(cases: DataFrame, lists: DataFrame) -> DataFrame:
    """Per case: failures of its list (``list_id`` = case name) and whether it passed."""
    per = lists.groupBy("list_id", "composer").agg(
        F.count("*").alias("c"), F.min("score").alias("s"), F.collect_set(F.lower("work_type")).alias("t"))
    per = per.groupBy("list_id").agg(
        F.max("c").alias("top"), F.min("s").alias("least"), F.flatten(F.collect_list("t")).alias("types"),
        F.collect_list("composer").alias("composers"))  # lists are top-k, so these arrays are short
    j = cases.join(per, cases["name"] == per["list_id"], "left")
    none = F.col("list_id").isNull()
    fails = F.array_compact(F.array(
        F.when(none, F.lit("No recommendations generated")),
        F.when(F.col("least") < F.col("min_score"),
               F.format_string("Minimum similarity %.3f below threshold %.2f", "least", "min_score")),
        F.when(~none & F.col("must_composer").isNotNull() & ~F.array_contains("composers", F.col("must_composer")),
               F.format_string("Expected composer '%s' not in recommendations", "must_composer")),
        F.when(~none & F.col("must_type").isNotNull() & ~F.array_contains("types", F.lower("must_type")),
               F.format_string("Expected work type '%s' not in recommendations", "must_type")),
        F.when(F.col("top") > F.col("max_same_composer"),
               F.format_string("Too many works from same composer: %d > %d", "top", "max_same_composer")),
    ))
    return j.select("name", fails.alias("failures")).withColumn("passed", F.size("failures") == 0)


def case_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        F.coalesce(F.count_if("passed") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("pass_rate"))


def full_report(lists: DataFrame, works: DataFrame, composers: DataFrame, checked: DataFrame, n_lists: int | None = 5, seed: int = 42) -> DataFrame:
    """Long ``(section, metric, value)``: distribution, coverage, mean diversity of some lists, cases."""
    div = list_diversity(lists)
    if n_lists is not None:
        div = div.orderBy(uniform("list_id", seed=seed), "list_id").limit(n_lists)
    mean_div = div.agg(
        F.avg("avg_pairwise_dissimilarity").alias("avg_pairwise_dissimilarity"),
        F.avg("unique_composers_ratio").alias("unique_composers_ratio"), F.avg("gini_coefficient").alias("gini_coefficient"))
    return unite([
        long_metrics(score_distribution(lists), "similarity_distribution"),
        long_metrics(catalog_coverage(lists, works, composers), "coverage"),
        long_metrics(mean_div, "diversity"),
        long_metrics(case_summary(checked), "cases"),
    ])


# --- searches ---------------------------------------------------------------------------------------

def expectations(spark) -> DataFrame:
    """``(query, feature)`` rows of the mood queries."""
    return spark.createDataFrame([(q, f) for q, fs in MOOD_QUERIES for f in fs], "query string, feature string")


def evaluate_queries(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query: results, mean score, share of expected features found in key, period, type and tags.

    ``results`` has ``query, score, key, period, work_type, tags``; ``expected`` has ``query, feature``.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("key", F.lit("")), F.coalesce("period", F.lit("")), F.coalesce("work_type", F.lit("")),
                               F.array_join("tags", " ")))
    found = (
        results.select("query", text.alias("text")).join(expected, "query")
        .groupBy("query", "feature").agg(F.count_if(F.col("text").contains(F.lower("feature"))).alias("hits"))
        .groupBy("query").agg(F.count_if(F.col("hits") > 0).alias("found"))
    )
    base = results.groupBy("query").agg(F.count("*").alias("num_results"), F.avg("score").alias("avg_similarity"))
    wanted = expected.groupBy("query").agg(F.count("*").alias("n_expected"))
    j = wanted.join(base, "query", "left").join(found, "query", "left")
    return j.select(
        "query", F.coalesce("num_results", F.lit(0)).alias("num_results"), F.coalesce("avg_similarity", F.lit(0.0)).alias("avg_similarity"),
        (F.coalesce("found", F.lit(0)) / F.col("n_expected")).alias("feature_coverage"))


def query_summary(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(
        F.count("*").alias("queries"), F.avg("avg_similarity").alias("avg_similarity_score"),
        F.avg("feature_coverage").alias("avg_feature_coverage"), F.avg("num_results").alias("avg_results_per_query"),
        (F.count_if(F.col("feature_coverage") >= 0.5) / F.count("*")).alias("coverage_rate"),
        (F.count_if(F.col("avg_similarity") >= 0.5) / F.count("*")).alias("high_similarity_rate"))


def run_overlap(runs: DataFrame, n: int) -> DataFrame:
    """Per query the mean share of results two runs have in common: ``runs`` has ``query, run, work_id``.

    A work found in c runs is common to c(c-1)/2 run pairs, so no runs are joined.
    """
    per = runs.groupBy("query", "work_id").agg(F.count_distinct("run").alias("c"))
    shared = per.groupBy("query").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("shared"))
    count = runs.groupBy("query").agg(F.count_distinct("run").alias("r"))
    pairs = F.col("r") * (F.col("r") - 1) / 2
    return shared.join(count, "query").select(
        "query", F.when(pairs > 0, F.col("shared") / pairs / n).otherwise(F.lit(0.0)).alias("avg_overlap_ratio"))


def result_coverage(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: works returned by the queries over works in the catalogue."""
    row = one_row(
        catalog.agg(F.count("*").alias("total_works_in_catalog")),
        results.agg(F.count_distinct("work_id").alias("works_returned"), F.count_distinct("query").alias("queries_tested")))
    total = F.col("total_works_in_catalog")
    ratio = F.when(total > 0, F.col("works_returned") / total).otherwise(F.lit(0.0))
    return row.select("*", ratio.alias("coverage_ratio"), (ratio * 100).alias("coverage_percentage"))


def result_diversity(results: DataFrame) -> DataFrame:
    """Per query: distinct composers, periods, types and keys, and their ratios to the results."""
    d = {"composers": "composer", "periods": "period", "work_types": "work_type", "keys": "key"}
    base = results.groupBy("query").agg(
        F.count("*").alias("num_results"), *[F.count_distinct(F.nullif(F.col(c).cast("string"), F.lit(""))).alias(f"unique_{n}") for n, c in d.items()])
    n = F.col("num_results")
    return base.select(
        "*", (F.col("unique_composers") / n).alias("composer_diversity_ratio"), (F.col("unique_periods") / n).alias("period_diversity_ratio"),
        (F.col("unique_work_types") / n).alias("work_type_diversity_ratio"))


def overall_health(similarity: Column, consistency: Column, coverage: Column, diversity: Column) -> tuple[Column, Column]:
    """Weighted score and its grade."""
    s = 0.4 * similarity + 0.3 * consistency + 0.2 * coverage + 0.1 * diversity
    return s, F.when(s >= 0.75, "excellent").when(s >= 0.6, "good").when(s >= 0.4, "fair").otherwise("poor")


def comprehensive(similarity: DataFrame, overlap: DataFrame, coverage: DataFrame, diversity: DataFrame) -> DataFrame:
    """One row from query evaluation, run overlap, coverage and result diversity."""
    row = one_row(
        similarity.agg(F.avg("avg_similarity").alias("avg_similarity_score")),
        overlap.agg(F.avg("avg_overlap_ratio").alias("avg_consistency")),
        coverage.select("coverage_ratio"),
        diversity.agg(F.avg("composer_diversity_ratio").alias("avg_composer_diversity")))
    s, grade = overall_health(*[F.col(c) for c in ("avg_similarity_score", "avg_consistency", "coverage_ratio", "avg_composer_diversity")])
    return row.select("*", s.alias("health_score"), grade.alias("overall_health"))
