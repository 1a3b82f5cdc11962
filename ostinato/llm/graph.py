"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.common import remove_path, stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node of ``edges`` (columns ``a``, ``b``, longs) but the roots.

    Each round is two minima by node (combined before the shuffle) and two joins, which the adaptive planner may split where a
    node has many edges. Rounds are written to the shared folder and the one before is deleted; the number of rounds
    grows with the logarithm of the longest chain. Loops, repeated and null edges are dropped.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, path = stored(down, "edges")
    spark, last = edges.sparkSession, None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_path = stored(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt, nxt_path = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        remove_path(spark, path)
        remove_path(spark, large_path)
        now, path = nxt, nxt_path
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = tuple(state)
