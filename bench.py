"""Timed headline queries; prints one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "v6_top_edges", "v11_embedding_search", "a9_group_consistency", "w5_repeated_violations", "j10_infer_composer_links",
    "v7_similar", "v3_tag_tfidf", "t2_top_per_seed", "e10_embedding_quality", "f2_work_type", "f11_explain_search", "f10_explain_similarity",
    "v5_pair_scores", "w4_latest_saved", "a17_feedback_stats", "a24_gini", "r4_token_bucket_replay", "g6_tag_untagged", "a4_load_report", "p2_conform_works",
]


def main() -> None:
    from ostinato.plans import all_queries
    from ostinato.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()[0]
    # start the engine and its Python workers before the clock
    spark.range(0, 1000, 1, int(cpus)).mapInPandas(lambda batches: batches, "id bigint").selectExpr("sum(id)").collect()
    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        t = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
