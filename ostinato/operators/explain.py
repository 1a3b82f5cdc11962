"""Explanations of recommendations and search results, as column expressions.

Reasons stay structured until the sentence is built, so nothing is read back from text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.functions.fixed_values import CHARACTER_WORDS, KEY_IN_TITLE
from ostinato.functions.titles import plain_key
from ostinato.operators.semantic import key_moods
from ostinato.operators.similarity import both_directions

NONE = "array<string>"


def join_words(items: Column) -> Column:
    """``a``, ``a and b``, ``a, b, and c``."""
    n = F.size(items)
    return (
        F.when(n <= 2, F.array_join(items, " and "))
        .otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(items, -1)))
    )


def article(word: Column, capital: bool = True) -> Column:
    vowel = F.lower(F.substring(word, 1, 1)).isin(list("aeiou"))
    an, a = ("An", "A") if capital else ("an", "a")
    return F.when(vowel, F.lit(an)).otherwise(F.lit(a))


def _capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.char_length(text))))


def _full(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def similarity_reasons(seed: Column, rec: Column) -> Column:
    """Shared facts of two structs ``(composer_id, work_type, key, period, tags)``; a slot is null when not shared."""
    def shared(field: str) -> Column:
        return F.when(_full(seed[field].cast("string")) == _full(rec[field].cast("string")), rec[field])

    common = F.array_intersect(F.coalesce(seed["tags"], F.array().cast(NONE)), F.coalesce(rec["tags"], F.array().cast(NONE)))
    return F.struct(
        shared("composer_id").isNotNull().alias("same_composer"),
        shared("work_type").alias("work_type"),
        plain_key(shared("key")).alias("key"),
        shared("period").alias("period"),
        F.array_min(common).alias("style"),
    )


def similarity_sentence(r: Column) -> Column:
    attrs = F.array_compact(F.array(r["period"], r["work_type"], F.when(r["key"].isNotNull(), F.concat(F.lit("in "), r["key"]))))
    n = F.size(attrs)
    return (
        F.when(r["same_composer"] & (n > 0), F.concat(
            F.lit("Like your selection, this is a "), F.array_join(attrs, " "), F.lit(" by the same composer")))
        .when(r["same_composer"], F.lit("From the same composer as your selection"))
        .when(n == 1, F.concat(F.lit("Like your selection, this is also "), F.array_join(attrs, "")))
        .when(n > 1, F.concat(F.lit("Shares "), join_words(attrs), F.lit(" with your selection")))
        .when(r["style"].isNotNull(), F.concat(F.lit("Features similar "), r["style"], F.lit(" character to your selection")))
        .otherwise(F.lit("Recommended based on overall musical similarity"))
    )


def explain_pairs(pairs: DataFrame, cards: DataFrame, both_ways: bool = False) -> DataFrame:
    """Add ``explanation`` to ``(src, dst, ...)`` rows; cards hold ``composer_id, work_type, key, period, tags``.

    With ``both_ways`` a pair stands for its reverse, too: an explanation names only what both share, so it holds for both.
    """
    fields = ["composer_id", "work_type", "key", "period", "tags"]

    def side(name: str) -> DataFrame:
        return cards.select(F.col("work_id").alias(name), F.struct(*fields).alias(f"_{name}"))

    j = pairs.join(side("src"), "src", "left").join(side("dst").hint("shuffle_hash"), "dst", "left")  # pairs with their first card are not sorted again
    told = j.select(*pairs.columns, similarity_sentence(similarity_reasons(F.col("_src"), F.col("_dst"))).alias("explanation"))
    names = [c for c in told.columns if c not in ("src", "dst")]
    return both_directions(told, names, names, names) if both_ways else told


# --- search explanations ------------------------------------------------------------------------------

def _moods_of(key: Column) -> Column:
    return F.split(key_moods(key), " ")


def semantic_reasons(df: DataFrame) -> DataFrame:
    """Add the struct ``reasons`` to rows ``(query, title, key, work_type, period, tags)``.

    Exact reasons: a key named in the query, else a key with a mood word of the query; tags and
    period named in the query.
    """
    none = F.array().cast(NONE)
    q = F.lower("query")
    in_title = F.coalesce(F.regexp_extract_all("title", F.lit("(?i)" + KEY_IN_TITLE), F.lit(1)), none)
    primary = F.array_compact(F.array(_full(plain_key("key"))))
    df = df.withColumns({
        "_keys": F.array_distinct(F.concat(primary, in_title)),
        "_tags": F.coalesce("tags", none),
        "_q": q,
    })
    named = F.filter("_keys", lambda k: F.col("_q").contains(F.lower(k)))
    # for each key its mood words that the query contains
    hits = F.filter(
        F.transform("_keys", lambda k: F.struct(
            k.alias("key"), F.filter(_moods_of(k), lambda m: (m != "") & F.col("_q").contains(m)).alias("moods"))),
        lambda x: F.size(x["moods"]) > 0)
    named_key = F.get(named, 0)
    first_hit = F.get(hits, 0)
    key = F.coalesce(named_key, first_hit["key"])
    moods = F.when(
        named_key.isNotNull(), F.slice(F.filter(_moods_of(named_key), lambda m: m != ""), 1, 2),
    ).otherwise(F.slice(first_hit["moods"], 1, 2))
    tags = F.slice(F.filter("_tags", lambda t: F.col("_q").contains(F.lower(t))), 1, 2)
    period = F.when((F.col("period") != "") & F.col("_q").contains(F.lower("period")), F.col("period"))
    df = df.withColumn("_exact", F.struct(
        key.alias("key"), F.coalesce(moods, none).alias("moods"), tags.alias("tags"), period.alias("period"), F.col("work_type").alias("work_type")))
    any_exact = F.col("_exact.key").isNotNull() | (F.size("_exact.tags") > 0) | F.col("_exact.period").isNotNull()

    # otherwise: what the work is like
    best_key = F.get("_keys", 0)
    best_moods = F.slice(F.filter(_moods_of(best_key), lambda m: m != ""), 1, 2)
    mood_phrase = F.when(F.size(best_moods) > 0, F.concat(F.array_join(best_moods, " and "), F.lit(" ("), best_key, F.lit(")")))
    telling = F.filter(F.slice("_tags", 1, 5), lambda t: F.exists(
        F.array(*map(F.lit, CHARACTER_WORDS)), lambda w: F.lower(t).contains(w)))
    two = F.when(F.size(telling) > 0, F.slice(telling, 1, 2)).otherwise(F.slice("_tags", 1, 2))
    features = F.concat(F.array_compact(F.array(mood_phrase)), two)
    wt = F.lower("work_type")
    shown = F.when((F.size(features) < 2) | ~wt.isin("symphony", "concerto"), wt)
    context = F.struct(
        F.lit(None).cast("string").alias("key"), none.alias("moods"), features.alias("tags"),
        _full(F.col("period")).alias("period"), F.coalesce(_full(shown), _full(F.col("work_type"))).alias("work_type"))
    # an exact reason uses the work type as stored
    return df.withColumn("reasons", F.when(any_exact, F.col("_exact")).otherwise(context)).drop("_keys", "_tags", "_q", "_exact")


def semantic_sentence(r: Column) -> Column:
    tags = F.slice(r["tags"], 1, 3)
    wt, period, key, moods = _full(r["work_type"]), r["period"], r["key"], r["moods"]
    has_tags = F.size(tags) > 0
    with_tags = F.when(has_tags, F.concat(F.lit(" with "), join_words(tags), F.lit(" character"))).otherwise(F.lit(""))
    phrase = F.when(key.isNotNull(), F.concat_ws(" ", F.when(F.size(moods) > 0, join_words(moods)), F.lit("in"), key))
    lead = F.concat_ws(" ", article(wt), period, wt)
    tail = F.when(wt.isNotNull(), F.concat(F.lit(", "), article(wt, False), F.lit(" "), wt)).otherwise(F.lit(""))
    both = period.isNotNull() & wt.isNotNull()
    return (
        F.when(both & phrase.isNotNull(), F.concat(lead, F.lit(" that's "), phrase, with_tags))
        .when(phrase.isNotNull(), F.concat(_capitalised(phrase), with_tags, tail))
        .when(has_tags & both, F.concat(lead, with_tags))
        .when(has_tags, F.concat(F.lit("Featuring "), join_words(tags), F.lit(" character")))
        .when(both, F.concat(lead, F.lit(" that matches your vibe")))
        .when(wt.isNotNull(), F.concat(article(wt), F.lit(" "), wt, F.lit(" that matches the mood you're looking for")))
        .when(period.isNotNull(), F.lit("Recommended based on musical similarity to your search"))
        .otherwise(F.lit("A piece that matches the mood you're looking for"))
    )


def explain_results(results: DataFrame) -> DataFrame:
    """Add ``explanation`` to rows ``(query, title, key, work_type, period, tags)``."""
    return semantic_reasons(results).withColumn("explanation", semantic_sentence(F.col("reasons"))).drop("reasons")
