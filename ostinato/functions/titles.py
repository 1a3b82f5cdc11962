"""Title parsers as column expressions: catalogue number, work type, key, period."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ostinato.functions.fixed_values import (
    ACTIVE_AGE,
    CATALOG_NUMBER_PATTERNS,
    FLAT_FORMS,
    KEY_GERMAN,
    KEY_SHORT_MAJOR,
    KEY_SHORT_MINOR,
    KEY_STANDARD,
    KEY_STANDARD_STRICT,
    KNOWN_TITLES,
    PERIODS,
    SHARP_FORMS,
    WORK_TYPE_PATTERNS,
)

# Java flags: i = ignore case, U = Unicode classes and Unicode case folding.
CI = "(?iU)"
CS = "(?U)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def needed_text(pattern: str) -> str:
    """Longest plain text every match of a pattern contains, in lower case (may be empty).

    Look-aheads, groups, classes, escapes and optional characters end a run of plain text.
    """
    p = re.sub(r"\(\?![^)]*\)", "\0", pattern)
    while "(" in p:
        p = re.sub(r"\([^()]*\)[?*+]?", "\0", p)
    p = re.sub(r"\[[^\]]*\][?*+]?", "\0", p)
    p = re.sub(r"\\[a-zA-Z][?*+]?|\\\.[?*]|\.[?*+]?(?<!\\\.)|[^\\\0][?*]", "\0", p)
    runs = p.replace("\\.", ".").split("\0")
    return max(runs, key=len).lower()


def _may_match(lowered: Column, patterns) -> Column:
    """Cheap test before the regular expressions: one of the needed texts occurs."""
    texts = {needed_text(p) for p in patterns}
    if "" in texts:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [lowered.contains(x) for x in sorted(texts)])


def catalog_number(title) -> Column:
    """First catalogue number of a title, by pattern order, as ``prefix number``."""
    t = _col(title)
    low = F.lower(t)
    found = [
        F.when(
            _may_match(low, [pattern]) & t.rlike(CI + pattern),
            F.concat(F.lit(prefix + " "), F.trim(F.regexp_extract(t, CI + pattern, 1))),
        )
        for pattern, prefix in CATALOG_NUMBER_PATTERNS
    ]
    return F.coalesce(*found)


def all_catalog_numbers(title) -> Column:
    """Every catalogue number of a title, pattern by pattern."""
    t = _col(title)

    def of(pattern: str, prefix: str) -> Column:
        numbers = F.regexp_extract_all(t, F.lit(CI + pattern), F.lit(1))
        return F.transform(numbers, lambda n: F.concat(F.lit(prefix + " "), F.trim(n)))

    found = F.concat(*[of(p, prefix) for p, prefix in CATALOG_NUMBER_PATTERNS])
    return F.coalesce(found, F.array().cast("array<string>"))


def _any_of(patterns) -> str:
    return CI + "|".join(f"(?:{p})" for p in patterns)


def work_type(title) -> Column:
    """Work type of a title: known titles first, then the general patterns; first match wins."""
    t = _col(title)
    rules = [([p], name) for p, name in KNOWN_TITLES]
    rules += [(patterns, name) for name, patterns in WORK_TYPE_PATTERNS]
    # neighbouring rules with one outcome are one alternation
    merged: list[tuple[list[str], str]] = []
    for patterns, name in rules:
        if merged and merged[-1][1] == name:
            merged[-1][0].extend(patterns)
        else:
            merged.append((list(patterns), name))
    # coalesce, not one CASE: a filter on the result is then not unfolded over all branches
    low = F.lower(t)
    return F.coalesce(*[F.when(_may_match(low, ps) & t.rlike(_any_of(ps)), F.lit(name)) for ps, name in merged])


def all_work_types(title) -> Column:
    """Every work type whose general patterns occur in a title (known titles are not used)."""
    t = _col(title)
    low = F.lower(t)
    hits = [F.when(_may_match(low, ps) & t.rlike(_any_of(ps)), F.lit(name)) for name, ps in WORK_TYPE_PATTERNS]
    return F.array_compact(F.array(*hits))


def _note(raw: Column) -> Column:
    rest = F.lower(F.substring(raw, 2, 10))
    sharp = reduce(lambda a, b: a | b, [rest.contains(s) for s in SHARP_FORMS])
    flat = reduce(lambda a, b: a | b, [rest.contains(s) for s in FLAT_FORMS])
    accidental = F.when(sharp, F.lit("♯")).when(flat, F.lit("♭")).otherwise(F.lit(""))
    return F.concat(F.upper(F.substring(raw, 1, 1)), accidental)


def musical_key(title, strict: bool = False) -> Column:
    """Key named in a title, e.g. ``D minor``.

    By default one-letter modes count too ("Cm", and also "am Klavier"); ``strict`` wants the word.
    """
    t = _col(title)
    standard = CI + (KEY_STANDARD_STRICT if strict else KEY_STANDARD)
    german, short_major, short_minor = CS + KEY_GERMAN, CS + KEY_SHORT_MAJOR, CS + KEY_SHORT_MINOR
    mode = F.lower(F.regexp_extract(t, standard, 2))
    standard_mode = F.when(mode.isin("minor", "min", "moll"), F.lit("minor")).otherwise(F.lit("major"))
    german_mode = F.when(F.lower(F.regexp_extract(t, german, 2)) == "dur", F.lit("major")).otherwise(
        F.lit("minor")
    )
    return (
        F.when(t.rlike(german), F.concat_ws(" ", _note(F.regexp_extract(t, german, 1)), german_mode))
        .when(t.rlike(standard), F.concat_ws(" ", _note(F.regexp_extract(t, standard, 1)), standard_mode))
        .when(t.rlike(short_major), F.concat(_note(F.regexp_extract(t, short_major, 1)), F.lit(" major")))
        .when(t.rlike(short_minor), F.concat(_note(F.regexp_extract(t, short_minor, 1)), F.lit(" minor")))
    )


def plain_key(key) -> Column:
    """Key spelled with ``#`` and ``b``, the spelling of the lookup tables."""
    return F.translate(_col(key), "♯♭", "#b")


def year_of(date) -> Column:
    """Year of an ISO date text; null when the text before the first hyphen is not a number."""
    return F.expr(f"try_cast(trim(split_part({date}, '-', 1)) AS INT)") if isinstance(date, str) else (
        F.trim(F.split_part(date, F.lit("-"), F.lit(1))).try_cast("int")
    )


def period_of(birth_year, death_year) -> Column:
    """Period from life dates: the middle of the life, or age forty when death is unknown."""
    b, d = _col(birth_year), _col(death_year)
    known_death = d.isNotNull() & (d != 0)
    ref = F.when(known_death, b + F.floor((d - b) / 2)).otherwise(b + ACTIVE_AGE)
    chain = None
    for name, start, end in PERIODS:
        inside = F.lit(True)
        if start is not None:
            inside = inside & (ref >= start)
        if end is not None:
            inside = inside & (ref < end)
        chain = F.when(inside, F.lit(name)) if chain is None else chain.when(inside, F.lit(name))
    return F.when(b.isNotNull() & (b != 0), chain)


def enrich_titles(works, title: str = "title", strict: bool = False):
    """Add ``catalog_number``, ``work_type`` and ``key`` to a works frame."""
    return works.select(
        "*",
        catalog_number(title).alias("catalog_number"),
        work_type(title).alias("work_type"),
        musical_key(title, strict).alias("key"),
    )
