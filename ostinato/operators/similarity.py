"""Weighted content similarity: pairs, one seed, all works."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ostinato.functions.vectors import sparse_dot
from ostinato.operators.blocks import CHUNK, top_items, top_within
from ostinato.operators.features import Weights
from ostinato.operators.shape import ranked
from ostinato.session import cut

DIGITS = 6
Side = Callable[[str], Column]


# --- column form: two sides a and b give feature columns by name ------------------------------------

def _same(a: Side, b: Side, *cols: str) -> Column:
    test = a(cols[0]) == b(cols[0])
    for c in cols[1:]:
        test = test & (a(c) == b(c))
    return F.when(test, 1.0).otherwise(0.0)


def _one_hot(w: Weights) -> list[tuple[float, tuple[str, ...]]]:
    names = {"composer": "name"}
    parts = [(w.composer, ("name",)), (w.period, ("period",)), (w.work_type, ("work_type",)), (w.country, ("country",))]
    return parts + [(w.composite, tuple(names.get(c, c) for c in combo)) for combo in w.combinations]


def dot_score(a: Side, b: Side, w: Weights) -> Column:
    """Dot product of the two weighted feature vectors, without building them."""
    categories = sum((_same(a, b, *cols) * (x * x) for x, cols in _one_hot(w)), F.lit(0.0))
    turn = 2 * 3.141592653589793 / 12
    keys = F.coalesce(F.cos((a("key_pos") - b("key_pos")) * turn), F.lit(0.0)) * w.key**2
    tags = sparse_dot(a("terms"), a("weights"), b("terms"), b("weights")) * w.tags**2
    flags = F.bit_count(a("flags").bitwiseAND(b("flags"))) * w.catalog**2
    return categories + keys + tags + flags


def l1_distance(a: Side, b: Side, w: Weights) -> Column:
    categories = sum(((1.0 - _same(a, b, *cols)) * (2 * x) for x, cols in _one_hot(w)), F.lit(0.0))
    turn = 2 * 3.141592653589793 / 12

    def part(side: Side, f) -> Column:
        return F.coalesce(f(side("key_pos") * turn), F.lit(0.0))

    keys = (F.abs(part(a, F.sin) - part(b, F.sin)) + F.abs(part(a, F.cos) - part(b, F.cos))) * w.key
    ma, mb = (F.map_from_arrays(s("terms"), s("weights")) for s in (a, b))
    either = F.array_union(a("terms"), b("terms"))
    diffs = F.transform(either, lambda t: F.abs(F.coalesce(F.element_at(ma, t), F.lit(0.0)) - F.coalesce(F.element_at(mb, t), F.lit(0.0))))
    tags = F.aggregate(diffs, F.lit(0.0), lambda s, x: s + x) * w.tags
    flags = F.bit_count(a("flags").bitwiseXOR(b("flags"))) * w.catalog
    return categories + keys + tags + flags


def _cosine(a, b, w):
    return dot_score(a, b, w) / F.sqrt(a("norm2") * b("norm2"))


def _euclidean(a, b, w):
    return 1 / (1 + F.sqrt(F.greatest(a("norm2") + b("norm2") - 2 * dot_score(a, b, w), F.lit(0.0))))


def _manhattan(a, b, w):
    return 1 / (1 + l1_distance(a, b, w))


METRICS: dict[str, Callable[[Side, Side, Weights], Column]] = {
    "cosine": _cosine, "euclidean": _euclidean, "manhattan": _manhattan, "dot": dot_score,
}


def register_metric(name: str, fn: Callable[[Side, Side, Weights], Column]) -> None:
    """Add a metric: ``fn(a, b, weights)`` gets the two sides as column getters and returns a column."""
    METRICS[name.lower()] = fn


def metric_fn(name: str) -> Callable[[Side, Side, Weights], Column]:
    try:
        return METRICS[name.lower()]
    except KeyError:
        raise ValueError(f"similarity metric must be one of {sorted(METRICS)}") from None


def both_directions(pairs: DataFrame, names: list[str], there: list[str], back: list[str]) -> DataFrame:
    """Two rows of each pair: ``src, dst`` with the columns ``there``, and the reverse with the columns ``back``, both under ``names``."""
    rows = [F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), *[F.col(c).alias(n) for c, n in zip(cols, names)]) for x, y, cols in (("src", "dst", there), ("dst", "src", back))]
    return pairs.select(F.inline(F.array(*rows)))


FEATURES = ["name", "period", "country", "work_type", "key", "key_pos", "terms", "weights", "flags", "norm2"]


def score_pairs(pairs: DataFrame, rows: DataFrame, metrics: list[str] = ("cosine",), w: Weights = Weights(), both_ways: bool = False) -> DataFrame:
    """Scores of given ``(src, dst)`` pairs, one column per metric.

    With ``both_ways`` a pair stands for its reverse, too, which is scored from the same joined row. The second join looks its rows up in a hash table of a part of ``rows``: pairs that carry the features of their first work are not sorted again.
    """
    def side(id_col: str, alias: str) -> DataFrame:
        return rows.select(F.col("work_id").alias(id_col), F.struct(*FEATURES).alias(alias))

    j = pairs.join(side("src", "_a"), "src").join(side("dst", "_b").hint("shuffle_hash"), "dst")
    a, b = (lambda c: F.col(f"_a.{c}")), (lambda c: F.col(f"_b.{c}"))

    def scores(x: Side, y: Side, names: list[str]) -> list[Column]:
        return [F.round(metric_fn(m)(x, y, w), DIGITS).alias(n) for m, n in zip(metrics, names)]

    if not both_ways:
        return j.select("src", "dst", *scores(a, b, metrics))
    there, back = ([f"_{way}{i}" for i in range(len(metrics))] for way in "ab")
    return both_directions(j.select("src", "dst", *scores(a, b, there), *scores(b, a, back)), metrics, there, back)


def _literal_side(row) -> Side:
    def get(c: str) -> Column:
        v = row[c]
        if c == "terms":
            return F.array(*map(F.lit, v)).cast("array<int>")
        if c == "weights":
            return F.array(*[F.lit(float(x)) for x in v]).cast("array<double>")
        return F.lit(v).cast("int") if c == "key_pos" else F.lit(v)

    return get


def similar_to(
    rows: DataFrame, work_id, n: int = 10, metric: str = "cosine", exclude_same: bool = True, w: Weights = Weights(),
    min_score: float | None = None, max_same_composer: int | None = None,
) -> DataFrame:
    """The n works most similar to one seed: ``(work_id, score, rank)``; an unknown id is an error.

    The seed is one row, read first, and enters the plan as literals: one pass and a bounded sort.
    """
    seed = rows.filter(F.col("work_id") == F.lit(work_id)).limit(1).collect()
    if not seed:
        raise ValueError(f"Work ID not found: {work_id}")
    a, b = _literal_side(seed[0]), F.col
    cands = rows.filter(F.col("work_id") != F.lit(work_id)) if exclude_same else rows
    scored = cands.select("work_id", "name", F.round(metric_fn(metric)(a, b, w), DIGITS).alias("score"))
    if min_score is not None:
        scored = scored.filter(F.col("score") >= min_score)
    if max_same_composer is not None:
        scored = ranked(scored, ["name"], [F.desc("score"), F.asc("work_id")], max_same_composer, "_c").drop("_c")
    top = scored.select("work_id", "score").orderBy(F.desc("score"), "work_id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "work_id")))


def similar_to_title(rows: DataFrame, works: DataFrame, query: str, n: int = 10, **options) -> DataFrame:
    """Works similar to the first title match; no match is an error."""
    from ostinato.operators.catalog import search_titles

    hit = search_titles(works, query, 1).select("work_id").collect()
    if not hit:
        raise ValueError(f"No works found matching query: '{query}'")
    return similar_to(rows, hit[0][0], n, **options)


# --- block form: all works against all works -----------------------------------------------------------

def content_block(w: Weights = Weights(), metric: str = "cosine") -> Callable:
    """Dense score block of two pandas frames of feature rows."""
    parts = _one_hot(w)
    if metric not in ("cosine", "euclidean", "manhattan", "dot"):
        raise ValueError("the block form knows cosine, euclidean, manhattan and dot")

    def score(q, i):
        import numpy as np
        import pandas as pd

        n = len(q)
        columns = ("name", "period", "country", "work_type", "key")
        codes = {c: pd.factorize(pd.concat([q[c], i[c]], ignore_index=True))[0].astype(np.int32) for c in columns}
        width = 1 + max([max(t) for f in (q, i) for t in f["terms"] if len(t)] or [0])

        def dense(f):
            m = np.zeros((len(f), width + 10))
            lens = f["terms"].map(len).to_numpy()
            if lens.sum():
                r = np.repeat(np.arange(len(f)), lens)
                m[r, np.concatenate([np.asarray(t, int) for t in f["terms"] if len(t)])] = (
                    np.concatenate([np.asarray(v, float) for v in f["weights"] if len(v)]) * w.tags)
            pos = f["key_pos"].to_numpy(float)
            known = ~np.isnan(pos)
            angle = np.where(known, pos, 0.0) * (2 * np.pi / 12)
            m[:, width] = np.where(known, np.sin(angle), 0.0) * w.key
            m[:, width + 1] = np.where(known, np.cos(angle), 0.0) * w.key
            flags = f["flags"].to_numpy(int)
            for bit in range(8):
                m[:, width + 2 + bit] = ((flags >> bit) & 1) * w.catalog
            return m

        a, b = dense(q), dense(i)
        na, nb = q["norm2"].to_numpy(float), i["norm2"].to_numpy(float)
        used = [d for d in range(a.shape[1]) if a[:, d].any() or b[:, d].any()]
        out = np.empty((n, len(i)))
        # a few rows at a time, so that the work arrays stay in cache
        for at in range(0, n, CHUNK):
            here = slice(at, min(at + CHUNK, n))
            eq = {c: v[:n][here, None] == v[None, n:] for c, v in codes.items()}
            both = [(x, np.logical_and.reduce([eq[c] for c in cols]) if len(cols) > 1 else eq[cols[0]]) for x, cols in parts]
            if metric == "manhattan":
                far = sum((~same) * (2 * x) for x, same in both)
                for d in used:
                    far += np.abs(a[here, d][:, None] - b[:, d][None, :])
                out[here] = 1 / (1 + far)
                continue
            dot = a[here] @ b.T
            for x, same in both:
                dot += same * (x * x)
            if metric == "cosine":
                dot /= np.sqrt(na[here])[:, None]
                dot /= np.sqrt(nb)[None, :]
            elif metric == "euclidean":
                dot = 1 / (1 + np.sqrt(np.maximum(na[here][:, None] + nb[None, :] - 2 * dot, 0.0)))
            out[here] = dot
        return out

    return score


def profiles(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Works with equal features share one profile.

    Returns ``(members, distinct)``: ``members (work_id, profile_id)``, and the distinct profiles with
    the ``k`` smallest ids of each.  The profile id is its smallest work id.
    """
    key = [F.coalesce(F.col("key_pos"), F.lit(-1)), *[F.col(c) for c in FEATURES if c not in ("key_pos", "norm2")]]
    h = F.xxhash64(*key)
    hh = F.hash(*key)
    keyed = rows.withColumns({"_h": h, "_g": hh})
    first = keyed.groupBy("_h", "_g").agg(F.min("work_id").alias("profile_id"))
    members = keyed.select("work_id", "_h", "_g").join(first, ["_h", "_g"]).select("work_id", "profile_id")
    ids = (
        ranked(members, ["profile_id"], [F.asc("work_id")], k, "_r").groupBy("profile_id")
        .agg(F.array_sort(F.collect_list("work_id")).alias("ids"))
    )
    distinct = rows.join(ids, rows["work_id"] == ids["profile_id"]).select("profile_id", "ids", *FEATURES)
    return members, distinct


#: Works are compared class by class: those that share all columns of a class, one class after another.
CLASSES = (("name",), ("period", "work_type"), ("period",), ("work_type",), ("country",))


def shared_most(tested: tuple[tuple[str, ...], ...], w: Weights, power: int = 2) -> float:
    """The most of the categories' weight that two works share which share no tested class."""
    parts = _one_hot(w)
    columns = sorted({c for _, cols in parts for c in cols})
    best = 0.0
    for n in range(len(columns) + 1):
        for same in combinations(columns, n):
            if not any(set(t) <= set(same) for t in tested):
                best = max(best, sum(x**power for x, cols in parts if set(cols) <= set(same)))
    return best


def class_bound(tested: tuple[tuple[str, ...], ...], metric: str, w: Weights, rest: float) -> float:
    """No two works that share no tested class have a better score.

    Let N be the squared norm of all categories, B the most of it that they can share, and ``rest`` the largest squared norm of
    key, tags and flags of any work: their cosine is at most (B + rest) / (N + rest).  Distances are at least those of the
    categories that they do not share.
    """
    parts = _one_hot(w)
    if metric == "manhattan":
        return 1 / (1 + 2 * (sum(x for x, _ in parts) - shared_most(tested, w, 1)))
    total, shared = sum(x * x for x, _ in parts), shared_most(tested, w)
    if metric == "euclidean":
        return 1 / (1 + (2 * (total - shared)) ** 0.5)
    return shared + rest if metric == "dot" else (shared + rest) / (total + rest)


def near_profiles(distinct: DataFrame, k: int, metric: str, w: Weights, classes: tuple[tuple[str, ...], ...] = CLASSES) -> DataFrame:
    """The k best profiles of each profile: ``(profile_id, item_id, score, rank)``.

    Profiles are first compared inside their composer, then inside wider classes.  A list whose last score beats everything
    outside the classes so far is final; only the others go on, and only those still open at the end are compared with all.
    """
    score = content_block(w, metric)
    total = sum(x * x for x, _ in _one_hot(w))
    rest = (distinct.agg(F.max("norm2")).first()[0] or total) - total
    open_, known, done = distinct, None, []
    for i, keys in enumerate(classes):
        found = top_within(distinct, list(keys), k, score, "profile_id", DIGITS, queries=None if i == 0 else open_).select("query_id", "item_id", "score")
        if known is not None:
            found = ranked(known.unionByName(found).distinct(), ["query_id"], [F.desc("score"), F.asc("item_id")], k).select("query_id", "item_id", "score")
        best = cut(found, "best")
        line = class_bound(classes[:i + 1], metric, w, rest) + 10.0**-DIGITS
        full = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("last"))
        final = full.filter((F.col("n") == k) & (F.col("last") > line)).select("query_id")
        done.append(best.join(final, "query_id", "left_semi"))
        known = best.join(final, "query_id", "left_anti")
        open_ = cut(open_.join(final, open_["profile_id"] == final["query_id"], "left_anti"), "open")
        if open_.isEmpty():
            break
    else:
        done.append(top_items(open_, distinct, k, score, "profile_id", "profile_id", DIGITS).select(F.col("profile_id").alias("query_id"), "item_id", "score"))
    lists = reduce(lambda a, b: a.unionByName(b), done)
    return ranked(lists, ["query_id"], [F.desc("score"), F.asc("item_id")], k).withColumnRenamed("query_id", "profile_id")


def all_edges(
    rows: DataFrame, k: int = 10, metric: str = "cosine", w: Weights = Weights(), min_score: float | None = None,
) -> DataFrame:
    """Top-k edges ``(src, dst, score, rank)`` of every work; exact, never n x n rows.

    Equal works are one profile, so copies cost nothing.  The k + 1 best profiles of a profile hold
    its k + 1 best works (any better work outside would have k + 1 profiles' first works before it).
    The list is joined back by profile and each work drops itself.
    """
    if metric not in ("cosine", "euclidean", "manhattan", "dot"):
        raise ValueError("the block form knows cosine, euclidean, manhattan and dot")
    members, distinct = (cut(f, "profiles") for f in profiles(cut(rows, "features"), k + 1))
    near = near_profiles(distinct.drop("ids"), k + 1, metric, w)
    if min_score is not None:
        near = near.filter(F.col("score") >= min_score)
    expanded = near.select(F.col("profile_id").alias("src_profile"), F.col("item_id").alias("profile_id"), "score").join(
        distinct.select("profile_id", "ids"), "profile_id").select("src_profile", "score", F.explode("ids").alias("dst"))
    best = ranked(expanded, ["src_profile"], [F.desc("score"), F.asc("dst")], k + 1, "_r")
    lists = best.groupBy("src_profile").agg(F.array_sort(F.collect_list(F.struct("_r", "dst", "score"))).alias("l"))
    j = members.select(F.col("work_id").alias("src"), F.col("profile_id").alias("src_profile")).join(lists, "src_profile")
    own = F.slice(F.filter("l", lambda x: x["dst"] != F.col("src")), 1, k)
    return j.select("src", F.posexplode(own).alias("rank", "x")).select(
        "src", F.col("x.dst").alias("dst"), F.col("x.score").alias("score"), (F.col("rank") + 1).alias("rank"))
