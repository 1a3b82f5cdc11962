"""Tag coverage, diversity, group consistency and before/after comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.operators.blocks import cogroup_blocks
from ostinato.operators.shape import one_row
from ostinato.session import cut


def coverage(tags: DataFrame, works: DataFrame) -> DataFrame:
    """One row of coverage figures; tagged ids count even when their work is absent."""
    per = tags.groupBy("work_id").agg(F.count("*").alias("n"))
    t = per.agg(
        F.count("*").alias("tagged_works"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_tag_associations"),
        F.coalesce(F.round(F.avg("n"), 2), F.lit(0.0)).alias("avg_tags_per_work"),
        F.coalesce(F.min("n"), F.lit(0)).alias("min_tags_per_work"), F.coalesce(F.max("n"), F.lit(0)).alias("max_tags_per_work"),
        F.coalesce(F.median("n"), F.lit(0.0)).alias("median_tags_per_work"),
    )
    row = one_row(t, works.agg(F.count("*").alias("total_works")))
    total, tagged = F.col("total_works"), F.col("tagged_works")
    return row.select(
        "*", (total - tagged).alias("untagged_works"),
        F.when(total > 0, F.round(tagged / total * 100, 2)).otherwise(F.lit(0.0)).alias("coverage_pct"),
    )


def diversity(tags: DataFrame) -> DataFrame:
    """One row: unique tags, uses, entropy in bits, share of the maximum, share of the top five tags."""
    counts = tags.filter("tag IS NOT NULL").groupBy("tag").agg(F.count("*").alias("n"))
    # entropy = log2(N) - sum(n log2 n) / N needs one pass over the counts
    sums = counts.agg(
        F.count("*").alias("unique_tags"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_uses"),
        F.sum(F.col("n") * F.log2("n")).alias("_nlogn"),
    )
    top = counts.orderBy(F.desc("n"), "tag").limit(5).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_top5"))
    row = one_row(sums, top)
    n, k = F.col("total_uses"), F.col("unique_tags")
    entropy = F.when(n > 0, F.log2(n) - F.col("_nlogn") / n).otherwise(F.lit(0.0))
    return row.select(
        "unique_tags", "total_uses", F.round(entropy, 3).alias("entropy"),
        F.when(k > 1, F.round(entropy / F.log2(k), 3)).otherwise(F.lit(0.0)).alias("normalized_entropy"),
        F.when(n > 0, F.round(F.col("_top5") / n * 100, 2)).otherwise(F.lit(0.0)).alias("top_5_concentration_pct"),
    )


def tag_extremes(tags: DataFrame, n: int = 10) -> DataFrame:
    """``(side, tag, uses)``: the n most and n least used tags."""
    counts = tags.filter("tag IS NOT NULL").groupBy("tag").agg(F.count("*").alias("uses"))
    most = counts.orderBy(F.desc("uses"), "tag").limit(n).select(F.lit("most").alias("side"), "tag", "uses")
    least = counts.orderBy("uses", F.desc("tag")).limit(n).select(F.lit("least").alias("side"), "tag", "uses")
    return most.unionByName(least)


def tags_with_group(tags: DataFrame, works: DataFrame, group: str) -> DataFrame:
    """Tags with a column of their work; tags without a work keep a null group."""
    return tags.join(works.select("work_id", group), "work_id", "left")


def _tag_sets(tags: DataFrame, works: DataFrame, groups: list[str]) -> DataFrame:
    """``(grouping, grp, tags, size, n_works)``: distinct tag sets of each group with the number of works having them.

    The sets are built once and then shown to every grouping column.
    """
    pairs = tags.filter("tag IS NOT NULL").select("work_id", "tag").distinct()
    sets = pairs.groupBy("work_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    value = F.explode(F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("grp")) for g in groups]))
    shown = sets.join(works.select("work_id", *groups), "work_id").select("tags", value.alias("v")).select("v.*", "tags")
    counted = shown.filter("grp IS NOT NULL AND grp <> ''").groupBy("grouping", "grp", "tags").agg(F.count("*").alias("n_works"))
    return counted.withColumn("size", F.size("tags"))


def group_similarities(tags: DataFrame, works: DataFrame, groups: list[str]) -> DataFrame:
    """``(grouping, grp, works_count, pairs, sum_similarity)``: Jaccard summed over all work pairs of each group.

    Works with equal tags are one row with their number.  The distinct sets of a group meet in blocks, so a large group is many
    tasks, and each task emits a single number; sets of any size take the same way.
    """
    g = ["grouping", "grp"]
    sets = cut(_tag_sets(tags, works, groups), "tag-sets")
    totals = sets.groupBy(*g).agg(F.sum("n_works").alias("works_count")).filter("works_count >= 2")
    return totals.join(_set_sums(sets), g, "left").select(
        *g, "works_count", (F.col("works_count") * (F.col("works_count") - 1) / 2).cast("bigint").alias("pairs"),
        F.coalesce("s", F.lit(0.0)).alias("sum_similarity"),
    )


def group_similarity(tags: DataFrame, works: DataFrame, group: str) -> DataFrame:
    """The same for one grouping column: ``(grp, works_count, pairs, sum_similarity)``."""
    return group_similarities(tags, works, [group]).drop("grouping")


def _set_sums(sets: DataFrame, block_rows: int = 2000) -> DataFrame:
    """``(grouping, grp, s)``: Jaccard summed over the pairs of works, from blocks of distinct sets."""
    g = ["grouping", "grp"]
    sizes = sets.groupBy(*g).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("tags"), F.col("blocks")).cast("int")
    rest = ("tags", "size", "n_works")
    # each pair of blocks once: the lower block on the left
    left = sets.join(sizes, g).withColumn("lb", block).select(*g, "lb", F.explode(F.sequence("lb", F.col("blocks") - 1)).alias("rb"), *rest)
    # renewed columns, so that both sides may come from one frame
    right = sets.join(sizes, g).withColumn("b", block).select(
        *[F.col(c).alias(c) for c in g], F.explode(F.sequence(F.lit(0), F.col("b"))).alias("lb"), F.col("b").alias("rb"), *[F.col(c).alias(c) for c in rest])

    def total(a, b):
        import numpy as np
        import pandas as pd

        if a.empty or b.empty:
            none = np.array([], object)
            return pd.DataFrame({"grouping": none, "grp": none, "s": np.array([], float)})
        vocab = {t: i for i, t in enumerate(sorted({t for ts in a["tags"] for t in ts}))}

        def matrix(col):
            m = np.zeros((len(col), len(vocab)), dtype=np.float32)
            for r, ts in enumerate(col):
                m[r, [vocab[t] for t in ts if t in vocab]] = 1.0
            return m

        inter = (matrix(a["tags"]) @ matrix(b["tags"]).T).astype("float64")
        sa, sb = a["size"].to_numpy()[:, None], b["size"].to_numpy()[None, :]
        na, nb = a["n_works"].to_numpy(float)[:, None], b["n_works"].to_numpy(float)[None, :]
        # inside one block every pair is met from both sides, and a set meets itself with similarity 1
        inside = a["lb"].iloc[0] == a["rb"].iloc[0]
        s = (inter / (sa + sb - inter) * na * nb).sum()
        s = (s - na.sum()) / 2 if inside else s
        return pd.DataFrame({"grouping": [a["grouping"].iloc[0]], "grp": [a["grp"].iloc[0]], "s": [float(s)]})

    tasks = 4 * int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # uneven groups: more tasks than slots
    parts = cogroup_blocks(left, right, [*g, "lb", "rb"], tasks, total, "grouping string, grp string, s double")
    return parts.groupBy(*g).agg(F.sum("s").alias("s"))


def consistency(tags: DataFrame, works: DataFrame, groups: list[str]) -> DataFrame:
    """``(grouping, grp, works_count, avg_similarity)`` for each grouping column."""
    return group_similarities(tags, works, groups).select(
        "grouping", "grp", "works_count", F.round(F.col("sum_similarity") / F.col("pairs"), 3).alias("avg_similarity"))


def compare(old: DataFrame, new: DataFrame, works: DataFrame) -> DataFrame:
    """One row: coverage and diversity before and after, and the deltas."""
    def named(df, side, cols):
        return df.select(*[F.col(c).alias(f"{side}_{c}") for c in cols])

    cov = ["coverage_pct", "avg_tags_per_work", "total_tag_associations"]
    div = ["unique_tags", "normalized_entropy"]
    row = one_row(
        named(coverage(old, works), "before", cov), named(coverage(new, works), "after", cov),
        named(diversity(old), "before", div), named(diversity(new), "after", div),
    )
    digits = {"coverage_pct": 2, "avg_tags_per_work": 2, "normalized_entropy": 3}

    def delta(c):
        d = F.col(f"after_{c}") - F.col(f"before_{c}")
        return (F.round(d, digits[c]) if c in digits else d).alias(f"delta_{c}")

    return row.select("*", *[delta(c) for c in cov + div])


def overall_score(tags: DataFrame, works: DataFrame, target_tags: int = 7) -> DataFrame:
    """One row: mean of coverage, normalised entropy and tags per work against the target, with its grade."""
    row = one_row(
        coverage(tags, works).select("coverage_pct", "avg_tags_per_work"), diversity(tags).select("normalized_entropy"))
    score = (F.least(F.col("coverage_pct") / 100, F.lit(1.0)) + F.col("normalized_entropy")
             + F.least(F.col("avg_tags_per_work") / target_tags, F.lit(1.0))) / 3
    grade = F.when(score >= 0.8, "EXCELLENT").when(score >= 0.6, "GOOD").otherwise("NEEDS IMPROVEMENT")
    return row.select("*", score.alias("overall_score"), grade.alias("grade"))
