"""Descriptions, key moods, query expansion, embeddings and embedding search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.functions.fixed_values import (
    DESCRIPTION_REPEATS,
    HINT_BWV,
    HINT_D,
    HINT_K,
    HINT_OPUS,
    KEY_MOODS,
    MAJOR_MOODS,
    MINOR_MOODS,
    QUERY_EXPANSIONS,
)
from ostinato.functions.titles import plain_key
from ostinato.functions.vectors import cosine
from ostinato.operators.blocks import MAX_TASKS, cosine_block, matrix, numbered_blocks, top_items, unpacked
from ostinato.operators.catalog import tags_of_works, with_composers
from ostinato.operators.shape import one_row, ranked
from ostinato.session import cut

#: Texts that a task cuts into words, about.
TEXTS_A_TASK = 5_000


def key_moods(key: Column) -> Column:
    """Mood words of a key: by name, else by mode, else empty; null for a null key."""
    table = F.create_map(*[F.lit(x) for k, v in KEY_MOODS.items() for x in (k.lower(), v)])
    k = F.lower(F.trim(key))
    by_mode = F.when(k.contains("minor"), F.lit(MINOR_MOODS)).when(k.contains("major"), F.lit(MAJOR_MOODS)).otherwise(F.lit(""))
    return F.when(key.isNotNull(), F.coalesce(F.element_at(table, k), by_mode))


def catalog_hint(number: Column) -> Column:
    """Character words from a catalogue number."""
    n, u = number, F.upper(number)
    return F.concat_ws(
        " ", F.when(u.contains("BWV"), HINT_BWV), F.when(n.contains("K.") | u.contains("KV"), HINT_K),
        F.when(n.contains("Op."), HINT_OPUS), F.when(n.startswith("D."), HINT_D))


def _again(text: Column, times: int) -> Column:
    return F.when(text.isNotNull() & (text != ""), F.concat_ws(" ", *[text] * times))


def describe_works(works: DataFrame, composers: DataFrame, tags: DataFrame, repeats: dict = DESCRIPTION_REPEATS) -> DataFrame:
    """``(work_id, description)``: weighted text of a work for embedding; absent parts are skipped."""
    j = with_composers(works, composers, ["name", "period"]).join(tags_of_works(tags), "work_id", "left")
    name = F.coalesce("name", F.lit("Unknown"))
    key = plain_key("key")
    moods = key_moods(key)
    mood_text = F.when(moods != "", F.concat(F.col("key"), F.lit(": "), moods))
    hint = F.coalesce(catalog_hint(F.col("catalog_number")), F.lit(""))
    parts = [
        F.concat(F.coalesce("title", F.lit("None")), F.lit(" by "), _again(name, repeats["composer"])),
        F.concat(_again(F.col("period"), repeats["period"]), F.lit(" period")),
        _again(F.col("work_type"), repeats["work_type"]),
        _again(mood_text, repeats["key_mood"]),
        F.concat(F.lit("Catalog: "), F.nullif(F.col("catalog_number"), F.lit(""))),
        F.concat(F.lit("Tags: "), _again(F.array_join("tags", " "), repeats["tags"])),
        F.nullif(hint, F.lit("")),
    ]
    return j.select("work_id", F.concat(F.concat_ws(". ", *parts), F.lit(".")).alias("description"))


# --- queries -----------------------------------------------------------------------------------------

def activity_query(activity: Column, context: Column) -> Column:
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat_ws(" ", activity, context)).otherwise(activity)


def expansions_of(query: Column) -> Column:
    """Expansions of the keywords a query contains, in table order."""
    q = F.lower(query)
    return F.array_compact(F.array(*[F.when(q.contains(k), F.lit(v)) for k, v in QUERY_EXPANSIONS.items()]))


def expand_query(query: Column) -> Column:
    words = expansions_of(query)
    return F.when(F.size(words) > 0, F.concat_ws(" ", query, F.array_join(words, " "))).otherwise(query)


def keyword_hits(queries: DataFrame, query: str = "query") -> DataFrame:
    """``(query_id, ord, keyword, expansion)`` rows of the keywords each query contains."""
    q = F.lower(query)
    hits = F.array_compact(F.array(*[
        F.when(q.contains(k), F.struct(F.lit(o).alias("ord"), F.lit(k).alias("keyword"), F.lit(v).alias("expansion")))
        for o, (k, v) in enumerate(QUERY_EXPANSIONS.items())]))
    return queries.select("query_id", F.explode(hits).alias("h")).select("query_id", "h.*")


# --- embeddings -----------------------------------------------------------------------------------------

def embed(df: DataFrame, id_col: str, text: str, encoder: Callable | None = None, batch: int = 32, dim: int = 384) -> DataFrame:
    """``(id, embedding array<float>)``.

    ``encoder`` is a plug-in factory called once per worker: ``encoder() -> fn(list[str]) -> matrix``.
    Without one, hashed TF-IDF vectors are computed in column expressions.
    """
    if encoder is None:
        return hashed_tfidf(df, id_col, text, dim)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        import pandas as pd

        encode = encoder()
        for pdf in batches:
            texts = pdf[text].fillna("").tolist()
            rows = [list(map(float, v)) for s in range(0, len(texts), batch) for v in encode(texts[s:s + batch])]
            yield pd.DataFrame({id_col: pdf[id_col], "embedding": rows})

    return df.select(id_col, text).mapInPandas(run, f"`{id_col}` {id_type}, embedding array<float>")


def hashed_tfidf(df: DataFrame, id_col: str, text: str, dim: int = 384) -> DataFrame:
    """Unit vectors of signed, hashed word weights ``(1 + ln tf) * idf`` over whole texts.

    Texts are spread before they are cut into words, as a file may hold many in one row group. A word's place and weight are made once a word, not once a text.
    """
    n = df.count()
    words = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1)))
    texts = df.select(id_col, text).repartition(min(MAX_TASKS, n // TEXTS_A_TASK + 1), F.xxhash64(id_col, text))
    tf = cut(texts.select(id_col, words.alias("w")).groupBy(id_col, "w").agg(F.count("*").alias("tf")), "words")  # read twice below
    h = F.md5("w")  # the place from its first 32 bits, the sign from the next four: any engine can repeat it
    sign = F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    # stored, so that the planner knows its size: only a large vocabulary makes the counts meet it by a shuffle
    vocabulary = cut(tf.groupBy("w").agg(F.count("*").alias("df")).select(
        "w", (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % dim).cast("int").alias("i"), (sign * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1)).alias("u")), "vocabulary")
    weighted = tf.join(vocabulary, "w").select(id_col, "i", ((1 + F.log("tf")) * F.col("u")).alias("x"))
    cells = weighted.filter(F.col(id_col).isNotNull()).repartition(id_col).groupBy(id_col, "i").agg(F.sum("x").alias("x"))  # one shuffle for both groupings
    packed = cells.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m"))  # <= dim entries
    dense = dense_unit(F.col("m"), dim)
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return df.select(id_col).join(packed.select(id_col, dense.alias("embedding")), id_col, "left").select(
        id_col, F.coalesce("embedding", zero).alias("embedding"))


def dense_unit(cells: Column, dim: int) -> Column:
    """The unit vector of ``dim`` floats with the given cells, an array of structs ``(i, x)`` in order of ``i``, each place once; zero if all are zero.

    Each cell brings the zeros up to the next one, so the work is cells and places, not places times a search among the cells.
    """
    length = F.sqrt(F.aggregate(cells, F.lit(0.0), lambda s, c: s + c["x"] * c["x"]))
    zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)
    following = F.slice(F.concat(F.transform(cells, lambda c: c["i"]), F.array(F.lit(dim))), 2, F.size(cells))
    # the length is beside each cell: inside the lambda it would be summed anew for each of them
    runs = F.zip_with(F.arrays_zip(cells.alias("c"), F.array_repeat(length, F.size(cells)).alias("n")), following, lambda a, end: F.concat(
        F.array((a["c"]["x"] / F.when(a["n"] > 0, a["n"]).otherwise(1.0)).cast("float")), zeros(end - a["c"]["i"] - 1)))
    first = F.when(F.size(cells) > 0, F.element_at(cells, 1)["i"]).otherwise(F.lit(dim))
    return F.concat(zeros(first), F.flatten(runs))


def search(
    queries: DataFrame, items: DataFrame, n: int = 10, min_score: float | None = 0.15, query_id: str = "query_id",
    item_id: str = "vec_id", vector: str = "embedding", exclude_same: bool = False,
) -> DataFrame:
    """Top n items by cosine for each query vector, at least ``min_score``."""
    return top_items(
        queries.select(query_id, vector), items.select(item_id, vector), n, cosine_block(vector), query_id, item_id,
        exclude_same=exclude_same, min_score=min_score)


def search_one(vector: list[float], items: DataFrame, n: int = 10, min_score: float | None = 0.15, item_id: str = "vec_id",
               column: str = "embedding") -> DataFrame:
    """Top n items for one query vector, fully in column expressions."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    scored = items.select(item_id, F.round(cosine(F.col(column), q), 6).alias("score"))
    if min_score is not None:
        scored = scored.filter(F.col("score") >= min_score)
    return ranked(scored.orderBy(F.desc("score"), item_id).limit(n), [], [F.desc("score"), F.asc(item_id)])


def hybrid(
    requests: DataFrame, items: DataFrame, n: int = 10, semantic_weight: float = 0.5, min_score: float = 0.15,
    query_id: str = "query_id", item_id: str = "vec_id", vector: str = "embedding", seed_col: str = "seed_id",
) -> DataFrame:
    """Search by query and seed: ``w * cos(query) + (1 - w) * cos(seed)``, seed left out, no threshold.

    Requests ``(query_id, embedding, seed_id)`` without a seed fall back to plain search with the
    threshold.  A seed that is not an item is an error.
    """
    seeded = requests.filter(F.col(seed_col).isNotNull()).select(query_id, vector, seed_col)
    vectors = items.select(F.col(item_id).alias(seed_col), F.col(vector).alias("_seed_vector"))
    both = seeded.join(vectors, seed_col, "left")
    lost = both.filter("_seed_vector IS NULL").select(seed_col).limit(1).collect()
    if lost:
        raise ValueError(f"Work ID not found: {lost[0][0]}")
    semantic, by_seed = cosine_block(vector), cosine_block("_v")

    def score(q, i):
        import numpy as np

        s = semantic_weight * semantic(q, i) + (1 - semantic_weight) * by_seed(
            q.assign(_v=q["_seed_vector"]), i.assign(_v=i[vector]))
        return np.where(q[seed_col].to_numpy()[:, None] == i[item_id].to_numpy()[None, :], -np.inf, s)

    combined = top_items(both, items.select(item_id, vector), n, score, query_id, item_id)
    plain = search(requests.filter(F.col(seed_col).isNull()), items, n, min_score, query_id, item_id, vector)
    return combined.unionByName(plain)


def best_query(items: DataFrame, queries: DataFrame, query_id: str = "query_id", item_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Score every item against every query and keep the item's best: ``(item_id, query_id, score)``."""
    return top_items(items.select(item_id, vector), queries.select(query_id, vector), 1, cosine_block(vector), item_id, query_id).drop("rank")


# --- quality of an embedding set -----------------------------------------------------------------------------

def pair_moments(items: DataFrame, vector: str = "embedding") -> DataFrame:
    """Mean and standard deviation of the cosine over all pairs of different items, in closed form.

    With unit vectors u and G the sum of their outer products, the pair sum is |sum u|^2 - m and the
    sum of squares is |G|^2 - m, where m vectors are not zero (a zero vector has cosine 0 with all); G has one cell per pair of dimensions, whatever the number of rows.
    """
    def partial(batches):
        import numpy as np
        import pandas as pd

        g = s = None
        rows = whole = 0
        for pdf in batches:
            if pdf.empty:
                continue
            m = matrix(pdf[vector])
            norms = np.linalg.norm(m, axis=1, keepdims=True)
            u = np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)
            g = u.T @ u if g is None else g + u.T @ u
            s = u.sum(axis=0) if s is None else s + u.sum(axis=0)
            rows += len(u)
            whole += int((norms > 0).sum())
        if g is not None:
            d = len(s)
            ii, jj = np.divmod(np.arange(d * d), d)
            yield pd.DataFrame({"i": ii, "j": jj, "x": g.ravel()})
            yield pd.DataFrame({"i": np.arange(d), "j": np.full(d, -1), "x": s})
            yield pd.DataFrame({"i": [-1, -1], "j": [-1, -2], "x": [float(rows), float(whole)]})

    cells = items.select(vector).mapInPandas(partial, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    row = cells.agg(
        F.sum(F.when((F.col("i") >= 0) & (F.col("j") >= 0), F.col("x") * F.col("x"))).alias("g2"),
        F.sum(F.when((F.col("i") >= 0) & (F.col("j") < 0), F.col("x") * F.col("x"))).alias("s2"),
        F.max(F.when((F.col("i") < 0) & (F.col("j") == -1), F.col("x"))).alias("n"),
        F.max(F.when((F.col("i") < 0) & (F.col("j") == -2), F.col("x"))).alias("own"))
    pairs = F.col("n") * (F.col("n") - 1)
    mean = (F.col("s2") - F.col("own")) / pairs
    return row.select(
        F.col("n").cast("bigint").alias("num_works"), mean.alias("mean"),
        F.sqrt(F.greatest((F.col("g2") - F.col("own")) / pairs - mean * mean, F.lit(0.0))).alias("std"))


#: A block is a ``BLOCK_SHARE``-th of the rows inside these bounds, so each row is sent as often whatever the table's size, until blocks are as large as may be.
BLOCK_SHARE, LEAST_ROWS, MOST_ROWS = 16, 512, 65_536
#: Rows and columns of the scores that a task holds at a time.
SCORE_ROWS, SCORE_COLUMNS = 256, 8192


def pair_histogram(items: DataFrame, id_col: str = "vec_id", vector: str = "embedding", digits: int = 6, block_rows: int | None = None) -> DataFrame:
    """``(score, n)`` over all pairs of different items, scores rounded.

    Blocks are stored as binary rows and meet in pairs, sent once to the task of their pair; a task counts the scores of its pairs in one array of
    ``2 * 10^digits + 1`` cells and leaves the cells that are not empty, at the end.
    """
    block_rows = block_rows or min(MOST_ROWS, max(LEAST_ROWS, -(-items.count() // BLOCK_SHARE)))
    rows = items.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    asked, n = numbered_blocks(rows, "id", block_rows, "_qb")
    # both blocks of a pair go to one task by its numbers, and are joined there
    every = F.sequence(F.lit(0), F.lit(n - 1))
    left = asked.select(F.col("_qb").alias("lb"), F.explode(F.filter(every, lambda x: x >= F.col("_qb"))).alias("rb"), F.col("blob").alias("a"))
    right = asked.select(F.explode(F.filter(every, lambda x: x <= F.col("_qb"))).alias("lb"), F.col("_qb").alias("rb"), F.col("blob").alias("b"))
    tasks = min(MAX_TASKS, n * (n + 1) // 2)
    pairs = left.repartition(tasks, "lb", "rb").hint("merge").join(right.repartition(tasks, "lb", "rb"), ["lb", "rb"])
    scale = 10**digits

    def count(batches):
        import numpy as np
        import pandas as pd

        cells = np.zeros(2 * scale + 1, np.int64)
        for batch in batches:
            for pair in batch.itertuples(index=False):
                a = unpacked(pair.a)
                b = a if pair.lb == pair.rb else unpacked(pair.b)
                ma, mb = matrix(a["v"]), matrix(b["v"])
                na, nb = np.linalg.norm(ma, axis=1), np.linalg.norm(mb, axis=1)
                ids = pd.factorize(a["id"], sort=True)[0]
                for at in range(0, len(a), SCORE_ROWS):
                    here = slice(at, at + SCORE_ROWS)
                    for first in range(0, len(b), SCORE_COLUMNS):
                        there = slice(first, first + SCORE_COLUMNS)
                        norms = na[here, None] * nb[None, there]
                        dots = ma[here] @ mb[there].T
                        s = np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
                        if pair.lb == pair.rb:
                            s = s[ids[here, None] < ids[None, there]]
                        places = np.clip(np.rint(s * scale).astype(np.int64), -scale, scale) + scale
                        cells += np.bincount(places.ravel(), minlength=len(cells))
        full = np.flatnonzero(cells)
        yield pd.DataFrame({"score": (full - scale) / scale + 0.0, "n": cells[full]})

    parts = pairs.mapInPandas(count, "score double, n bigint")
    return parts.groupBy("score").agg(F.sum("n").alias("n"))


def histogram_quantiles(hist: DataFrame, **quantiles: float) -> DataFrame:
    """Linear-interpolation quantiles of a ``(score, n)`` histogram, with minimum and maximum."""
    from pyspark.sql.window import Window

    # the histogram is bounded (see pair_histogram), so one sorted pass over it is fine
    up_to = Window.orderBy("score")
    c = hist.withColumns({
        "hi": F.sum("n").over(up_to),
        "total": F.sum("n").over(up_to.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    rows = c.withColumn("lo", F.col("hi") - F.col("n"))
    aggs = [F.min("score").alias("min"), F.max("score").alias("max")]
    for name, q in quantiles.items():
        place = (F.col("total") - 1) * q
        low, high = F.floor(place), F.ceil(place)
        at = lambda p: F.max(F.when((F.col("lo") <= p) & (p < F.col("hi")), F.col("score")))
        frac = F.max(place - low)
        aggs.append((at(low) + (at(high) - at(low)) * frac).alias(name))
    return rows.agg(*aggs)


def description_stats(descriptions: DataFrame) -> DataFrame:
    n = F.length("description")
    return descriptions.agg(F.avg(n).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"))


def embedding_quality(items: DataFrame, descriptions: DataFrame | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row: pair cosine mean, std, min, max, median, quartiles; description lengths when given."""
    parts = [pair_moments(items, vector), histogram_quantiles(pair_histogram(items, id_col, vector), q25=0.25, median=0.5, q75=0.75)]
    if descriptions is not None:
        parts.append(description_stats(descriptions))
    return one_row(*parts)
