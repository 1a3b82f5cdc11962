"""Re-ranking and sampling: maximal marginal relevance, weighted and uniform samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ostinato.operators.shape import ranked
from ostinato.session import cut


def diverse(
    items: DataFrame, seeds: DataFrame | list, n: int = 10, relevance_weight: float = 0.3, score: Callable | None = None,
    item_id: str = "work_id", digits: int = 6, seed_rows: int = 256, block_rows: int = 8192,
) -> DataFrame:
    """Greedy diverse lists for many seeds: ``(seed_id, item_id, score, rank)``.

    ``seeds`` is a frame with the item id, or a list of ids.  Each round picks, over all items, the largest
    ``w * relevance - (1 - w) * redundancy``, where redundancy is the largest similarity to the picks so far (0 in the first
    round); the reported score is the relevance.  A round is one pass of blocks of seeds, with their picks of at most n rows each,
    against blocks of items; every block pair leaves one item a seed.  Seeds and picks stay in stored frames.
    """
    from ostinato.operators.blocks import cogroup_blocks
    from ostinato.operators.similarity import content_block

    spark = items.sparkSession
    score = score or content_block()
    items = cut(items.dropDuplicates([item_id]), "mmr-items")
    cols, row_type = items.columns, items.schema.simpleString()
    id_type = items.schema[item_id].dataType.simpleString()
    if not isinstance(seeds, DataFrame):
        seeds = spark.createDataFrame([(s,) for s in seeds], f"`{item_id}` {id_type}")
    seeds = seeds.select(item_id).distinct()
    unknown = seeds.join(items, item_id, "left_anti").orderBy(item_id).head()
    if unknown is not None:
        raise ValueError(f"Work ID not found: {unknown[0]}")
    seeds = cut(seeds.join(items, item_id).select(*cols), "mmr-seeds")
    seed_blocks, item_blocks = max(1, -(-seeds.count() // seed_rows)), max(1, -(-items.count() // block_rows))
    keys = ["_sb", "_ib"]

    def blocked(df: DataFrame, own: str, other: str, n_own: int, n_other: int) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64(item_id), F.lit(n_own)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    spread = blocked(items, "_ib", "_sb", item_blocks, seed_blocks)
    out_schema = f"_seed {id_type}, _mmr double, _rel double, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)

    def best_of(s, pdf):
        import numpy as np
        import pandas as pd

        found, tops = {"_seed": [], "_mmr": [], "_rel": []}, []
        if not s.empty and not pdf.empty:
            pdf = pdf.sort_values(item_id, kind="stable").reset_index(drop=True)
            ids, rel = pdf[item_id].to_numpy(), score(s[cols], pdf[cols])
            flat = pd.DataFrame([p for picks in s["_picks"] for p in picks], columns=cols)
            sims, at = (score(flat, pdf[cols]) if len(flat) else None), 0
            for r, (seed, picks) in enumerate(zip(s[item_id], s["_picks"])):
                red = sims[at:at + len(picks)].max(axis=0) if len(picks) else 0.0
                at += len(picks)
                mmr = np.round(relevance_weight * rel[r] - (1 - relevance_weight) * red, digits)
                mmr = np.where(np.isin(ids, [seed, *(p[item_id] for p in picks)]), -np.inf, mmr)
                top = int(np.argmax(mmr))
                if np.isfinite(mmr[top]):
                    tops.append(top)
                    for name, value in zip(found, (seed, float(mmr[top]), round(float(rel[r, top]), digits))):
                        found[name].append(value)
        return pd.concat([pd.DataFrame(found), pdf[cols].iloc[tops].reset_index(drop=True)], axis=1)

    chosen = None
    for rank in range(1, n + 1):
        if chosen is None:
            asked = seeds.withColumn("_picks", F.array().cast(f"array<{row_type}>"))
        else:
            picks = chosen.groupBy(F.col("_seed").alias("_of")).agg(F.collect_list(F.struct(*cols)).alias("_picks"))  # at most n rows a seed
            asked = seeds.join(picks, seeds[item_id] == picks["_of"]).drop("_of")
        found = cogroup_blocks(blocked(asked, "_sb", "_ib", seed_blocks, item_blocks), spread, keys, seed_blocks * item_blocks, best_of, out_schema)
        best = ranked(found, ["_seed"], [F.desc("_mmr"), F.col(item_id)], 1, "_r").drop("_r").withColumn("rank", F.lit(rank))
        best = cut(best, "mmr-picks")
        if best.isEmpty():
            break
        chosen = best if chosen is None else chosen.unionByName(best)
    if chosen is None:
        return spark.createDataFrame([], f"seed_id {id_type}, item_id {id_type}, score double, rank int")
    return chosen.select(F.col("_seed").alias("seed_id"), F.col(item_id).alias("item_id"), F.col("_rel").alias("score"), "rank")


def uniform(*cols, seed):
    """Number in (0, 1) that the columns, as text, and a seed (or column of seeds) decide: 52 bits of their MD5, so any engine can repeat it."""
    text = F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in [*cols, F.lit(seed)]])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def sample_by_score(valid: DataFrame, n: int, key: str, item: str, multiplier: int = 3, seed: int = 42) -> DataFrame:
    """Diversity sampling per query over scored rows ``(key, item, score)`` with positive scores.

    From the best ``multiplier * n`` rows, n are drawn without replacement with chance by score
    (smallest ``-ln(u) / score`` first) and sorted by score again.  Queries with at most n rows keep
    them all.
    """
    pool = ranked(valid, [key], [F.desc("score"), F.asc(item)], multiplier * n, "_p")
    race = -F.log(uniform(F.col(key), F.col(item), seed=seed)) / F.greatest("score", F.lit(1e-12))
    drawn = ranked(pool.withColumn("_k", race), [key], [F.asc("_k"), F.asc(item)], n, "_d")
    return ranked(drawn.drop("_p", "_k", "_d"), [key], [F.desc("score"), F.asc(item)])


def sampled_runs(valid: DataFrame, n: int, key: str, item: str, runs: int = 5, multiplier: int = 3, seed: int = 42) -> DataFrame:
    """The same search drawn ``runs`` times, each with a seed of its own: ``(key, run, item, score, rank)``.

    The pool is cut once; each run is a draw of its rows, so the search itself is not repeated.
    """
    pool = ranked(valid, [key], [F.desc("score"), F.asc(item)], multiplier * n, "_p").select(key, item, "score")
    drawn = pool.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    race = -F.log(uniform(key, item, seed=F.col("run") + (seed - 1))) / F.greatest("score", F.lit(1e-12))
    kept = ranked(drawn.withColumn("_k", race), [key, "run"], [F.asc("_k"), F.asc(item)], n, "_d").drop("_k", "_d")
    return ranked(kept, [key, "run"], [F.desc("score"), F.asc(item)])


def sample_works(works: DataFrame, k: int, seed: int = 42, with_composer: bool = False, id_col: str = "work_id") -> DataFrame:
    """k works without replacement, reproducible for a seed."""
    pool = works.filter("composer_id IS NOT NULL") if with_composer else works
    return pool.orderBy(uniform(id_col, seed=seed), id_col).limit(k)


def pick_one(scored: DataFrame, seed: int = 42, top: int = 5, item: str = "work_id") -> DataFrame:
    """One of the best ``top`` rows, by a seeded draw."""
    best = scored.orderBy(F.desc("score"), item).limit(top)
    return best.orderBy(uniform(item, seed=seed), item).limit(1)


def pick_one_per(scored: DataFrame, key: str, seed: int = 42, top: int = 5, item: str = "work_id") -> DataFrame:
    """The same for each key of a batch."""
    best = ranked(scored, [key], [F.desc("score"), F.asc(item)], top, "_t")
    w = Window.partitionBy(key).orderBy(uniform(key, item, seed=seed), F.col(item))
    return best.withColumn("_h", F.row_number().over(w)).filter("_h = 1").drop("_h", "_t")
