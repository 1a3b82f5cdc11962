"""Content features of works: categories, circle of fifths, tag TF-IDF, catalogue flags, weights."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ostinato.functions.fixed_values import CATALOG_FLAGS, CIRCLE_OF_FIFTHS, FEATURE_WEIGHTS
from ostinato.functions.titles import plain_key
from ostinato.operators.catalog import fill_for_features, tags_of_works, with_composers
from ostinato.operators.shape import numbered_in_order, one_row
from ostinato.session import cut

GROUPS = ("composer", "period", "work_type", "country")
COLUMN_OF = {"composer": "name", "period": "period", "work_type": "work_type", "country": "country"}
DEFAULT_COMBINATIONS = (("period", "work_type"), ("period", "key"))


@dataclass(frozen=True)
class Weights:
    """Group weights; composites and country follow from period and work type unless given."""

    composer: float = FEATURE_WEIGHTS["composer"]
    period: float = FEATURE_WEIGHTS["period"]
    work_type: float = FEATURE_WEIGHTS["work_type"]
    key: float = FEATURE_WEIGHTS["key"]
    tags: float = FEATURE_WEIGHTS["tags"]
    catalog: float = FEATURE_WEIGHTS["catalog"]
    combinations: tuple = field(default=DEFAULT_COMBINATIONS)

    @property
    def composite(self) -> float:
        return (self.period + self.work_type) / 2

    @property
    def country(self) -> float:
        return self.period * 0.5


def prepare(works: DataFrame, composers: DataFrame) -> DataFrame:
    """Works joined with their composers, missing texts filled."""
    return fill_for_features(with_composers(works, composers, ["name", "period", "country"]))


def circle_position(key: Column) -> Column:
    """Position on the circle of fifths, null for other keys."""
    table = F.create_map(*[F.lit(x) for kv in CIRCLE_OF_FIFTHS.items() for x in kv])
    return F.element_at(table, plain_key(key))


def key_vector(key: Column) -> tuple[Column, Column]:
    """(sin, cos) on the circle of fifths; unknown keys are (0, 0)."""
    angle = circle_position(key) * (2 * 3.141592653589793 / 12)
    return F.coalesce(F.sin(angle), F.lit(0.0)), F.coalesce(F.cos(angle), F.lit(0.0))


def catalog_flags(number: Column) -> Column:
    """Bit mask of the catalogue flags."""
    bits = [F.when(number.rlike("(?iU)" + p), F.lit(1 << i)).otherwise(0) for i, p in enumerate(CATALOG_FLAGS.values())]
    return reduce(lambda a, b: a + b, bits).cast("int")


def composite(a: str, b: str) -> Column:
    return F.concat_ws("_", a, b)


def one_hot_categories(prepared: DataFrame, group: str) -> DataFrame:
    """Sorted categories of a group with their column number: ``(feature, position)``."""
    col = COLUMN_OF.get(group, group)
    names = prepared.select(F.col(col).alias("category")).distinct()
    return numbered_in_order(names, "category").select(F.concat(F.lit(f"{group}_"), "category").alias("feature"), "position")


def one_hot(prepared: DataFrame, group: str) -> DataFrame:
    """Sparse one-hot export ``(work_id, feature, value)``."""
    col = COLUMN_OF.get(group, group)
    return prepared.select("work_id", F.concat(F.lit(f"{group}_"), F.col(col)).alias("feature"), F.lit(1.0).alias("value"))


# --- tag TF-IDF --------------------------------------------------------------------------------

UNTAGGED = "no_tags"


def tag_terms(
    works: DataFrame, tags: DataFrame, ngrams: tuple[int, int] = (1, 2), untagged_term: str | None = UNTAGGED,
    include_source_tags: bool = False,
) -> DataFrame:
    """``(work_id, term, tf)``: word n-grams of each work's tag text.

    A work's text is its tags joined by spaces; n-grams cross tag borders.  Untagged works get one
    literal term unless ``untagged_term`` is None.
    """
    ids = works.select("work_id", *(["mb_tags"] if include_source_tags else []))
    lists = tags_of_works(tags.filter("tag IS NOT NULL").join(works.select("work_id"), "work_id", "left_semi"))
    j = ids.join(lists, "work_id", "left")
    none = F.array().cast("array<string>")
    words_of = F.coalesce("tags", none)
    if include_source_tags:
        words_of = F.concat(words_of, F.coalesce("mb_tags", none))
    text = F.when(F.size(words_of) > 0, F.array_join(words_of, " ")).otherwise(F.lit(untagged_term))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\b\w+\b)"), F.lit(1))

    def grams_of(n: int):
        places = F.sequence(F.lit(1), F.size("words") - (n - 1))
        runs = F.transform(places, lambda i: F.array_join(F.slice("words", i, n), " "))
        return F.when(F.size("words") >= n, runs).otherwise(none)

    grams = [grams_of(n) for n in range(ngrams[0], ngrams[1] + 1)]
    rows = j.select("work_id", F.coalesce(words, none).alias("words")).select("work_id", F.explode(F.concat(*grams)).alias("term"))
    return rows.groupBy("work_id", "term").agg(F.count("*").alias("tf"))


def fit_vocabulary(terms: DataFrame, n_docs: int, max_features: int = 100, min_df: int = 1) -> DataFrame:
    """``(term, term_id, idf)``: the most frequent terms (ties by term), numbered by name.

    At most ``max_features`` rows, so it may travel to every task.
    """
    stats = terms.groupBy("term").agg(F.sum("tf").alias("ctf"), F.count("*").alias("df")).filter(F.col("df") >= min_df)
    top = stats.orderBy(F.desc("ctf"), "term").limit(max_features)
    idf = F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    return top.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("term_id"), idf.alias("idf"))


def tfidf(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(work_id, term_id, weight)`` with rows of unit length."""
    raw = terms.join(F.broadcast(vocabulary), "term").select("work_id", "term_id", (F.col("tf") * F.col("idf")).alias("w"))
    norms = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    packed = raw.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("term_id", "w"))).alias("v"))  # <= vocabulary size
    return packed.select(
        "work_id", F.transform("v", lambda x: x["term_id"]).alias("terms"), F.transform("v", lambda x: x["w"] / norms).alias("weights"))


def tag_tfidf(
    works: DataFrame, tags: DataFrame, max_features: int = 100, ngrams=(1, 2), untagged_term: str | None = UNTAGGED,
    min_df: int = 1, include_source_tags: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Fit and apply: ``(vectors, vocabulary)`` with vectors ``(work_id, terms, weights)``."""
    terms = cut(tag_terms(works, tags, ngrams, untagged_term, include_source_tags), "tag-terms")  # read twice below
    vocabulary = fit_vocabulary(terms, works.count(), max_features, min_df)
    return tfidf(terms, vocabulary), vocabulary


# --- the feature row ----------------------------------------------------------------------------------

def feature_rows(works: DataFrame, composers: DataFrame, vectors: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """One row per work: categories, key position, tag vector, catalogue flags and the squared norm.

    Works with one composer, type, key, tag set and catalogue kind have equal rows but for the id.
    """
    p = prepare(works, composers)
    j = p.join(vectors, "work_id", "left")
    terms = F.coalesce("terms", F.array().cast("array<int>"))
    w = F.coalesce("weights", F.array().cast("array<double>"))
    pos = circle_position(F.col("key"))
    flags = catalog_flags(F.col("catalog_number"))
    fixed = (weights.composer**2 + weights.period**2 + weights.work_type**2 + weights.country**2
             + weights.composite**2 * len(weights.combinations))
    norm2 = (
        F.lit(fixed) + F.when(pos.isNotNull(), weights.key**2).otherwise(0.0)
        + F.when(F.size(terms) > 0, weights.tags**2).otherwise(0.0) + F.bit_count(flags) * weights.catalog**2
    )
    return j.select(
        "work_id", "name", "period", "country", "work_type", "key", pos.cast("int").alias("key_pos"), terms.alias("terms"),
        w.alias("weights"), flags.alias("flags"), norm2.alias("norm2"),
    )


def group_ranges(works: DataFrame, composers: DataFrame, vocabulary: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """``(feature_group, n_features)`` of the dense layout the rows stand for."""
    p = prepare(works, composers)
    combos = [F.count_distinct(composite(a, b)) for a, b in weights.combinations]
    row = one_row(
        p.agg(
            *[F.count_distinct(COLUMN_OF[g]).alias(g) for g in GROUPS],
            (reduce(lambda x, y: x + y, combos) if combos else F.lit(0).cast("bigint")).alias("composite"),
        ).withColumns({"key": F.lit(2).cast("bigint"), "catalog": F.lit(len(CATALOG_FLAGS)).cast("bigint")}),
        vocabulary.agg(F.count("*").alias("tags")),
    )
    cells = [F.struct(F.lit(c).alias("feature_group"), F.col(c).alias("n_features")) for c in row.columns]
    return row.select(F.explode(F.array(*cells)).alias("g")).select("g.*")


def feature_group(rows: DataFrame, group: str, vocabulary: DataFrame | None = None, weights: Weights = Weights()) -> DataFrame:
    """Sparse weighted columns of one group: ``(work_id, feature, value)``."""
    if group in COLUMN_OF:
        w = {"composer": weights.composer, "period": weights.period, "work_type": weights.work_type, "country": weights.country}[group]
        return one_hot(rows, group).withColumn("value", F.col("value") * w)
    if group == "key":
        s, c = key_vector(F.col("key"))
        cells = F.array(*[F.struct(F.lit(n).alias("feature"), (v * weights.key).alias("value"))
                          for n, v in (("key_circle_sin", s), ("key_circle_cos", c))])
        return rows.select("work_id", F.explode(cells).alias("x")).select("work_id", "x.*")
    if group == "catalog":
        cells = F.array_compact(F.array(*[
            F.when(F.col("flags").bitwiseAND(1 << i) > 0, F.struct(F.lit(f"catalog_{n}").alias("feature"), F.lit(weights.catalog).alias("value")))
            for i, n in enumerate(CATALOG_FLAGS)]))
        return rows.select("work_id", F.explode(cells).alias("x")).select("work_id", "x.*")
    if group == "composite":
        cells = F.array(*[F.struct(F.concat(F.lit("composite_"), composite(a, b)).alias("feature"), F.lit(weights.composite).alias("value"))
                          for a, b in weights.combinations])
        return rows.select("work_id", F.explode(cells).alias("x")).select("work_id", "x.*")
    if group == "tags":
        cells = F.arrays_zip(F.col("terms").alias("term_id"), F.col("weights").alias("w"))
        long = rows.select("work_id", F.explode(cells).alias("x")).select("work_id", F.col("x.term_id"), F.col("x.w").alias("w"))
        return long.join(F.broadcast(vocabulary), "term_id").select(
            "work_id", F.concat(F.lit("tag_"), "term").alias("feature"), (F.col("w") * weights.tags).alias("value"))
    raise ValueError(f"unknown feature group: {group}")


def tags_long(vectors: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(work_id, term, weight)`` of the TF-IDF vectors."""
    cells = F.arrays_zip(F.col("terms").alias("term_id"), F.col("weights").alias("weight"))
    long = vectors.select("work_id", F.explode(cells).alias("x")).select("work_id", "x.term_id", "x.weight")
    return long.join(F.broadcast(vocabulary), "term_id").select("work_id", "term", "weight")
