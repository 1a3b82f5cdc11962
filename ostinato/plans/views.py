"""Catalogue tables bound to the star-schema test tables.

Each view is one SQL text that both engines run.  ``Tables`` gives the views as DataFrames;
``with_ctes`` gives the same views as the WITH clause of a checking query.
"""

from __future__ import annotations

import hashlib
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.functions.fixed_values import (
    CATALOG_NUMBER_PATTERNS,
    KEY_GERMAN,
    KEY_SHORT_MAJOR,
    KEY_SHORT_MINOR,
    KEY_STANDARD,
    KNOWN_TITLES,
    PERIODS,
    WORK_TYPE_PATTERNS,
)
from ostinato.functions.titles import enrich_titles, period_of
from ostinato.session import cut, shared_folder
from ostinato.sources.catalogue import kept, spread

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

TITLE = """concat(CASE p_partkey % 8 WHEN 0 THEN 'Symphony' WHEN 1 THEN 'Piano Concerto' WHEN 2 THEN 'String Quartet'
      WHEN 3 THEN 'Sonata' WHEN 4 THEN 'Nocturne' WHEN 5 THEN 'Scherzo' WHEN 6 THEN 'Polka' ELSE p_name END,
    ' in ', substr('CDEFGAB', CAST(p_partkey % 7 + 1 AS INT), 1),
    CASE WHEN p_size % 2 = 0 THEN ' major' ELSE ' minor' END, ', ',
    CASE p_partkey % 5 WHEN 0 THEN 'Op. ' WHEN 1 THEN 'BWV ' WHEN 2 THEN 'K. ' WHEN 3 THEN 'RV ' ELSE 'take ' END,
    CAST(p_size AS VARCHAR(9)))"""
COMPOSER = "CASE WHEN p_partkey % 13 = 12 THEN NULL ELSE CAST(p_partkey % 10 AS BIGINT) END"
UUID = "concat('0a1b2c3d-0000-4000-8000-', lpad(CAST(p_partkey AS VARCHAR(12)), 12, '0'))"
DIRTY_TITLE = f"""CASE WHEN p_partkey % 101 = 7 THEN {UUID} WHEN p_partkey % 101 = 8 THEN 'Untitled'
      WHEN p_partkey % 101 = 9 THEN NULL ELSE concat('  ', {TITLE}) END"""

RAW = {
    "raw_works": f"SELECT CAST(p_partkey AS BIGINT) AS work_id, {COMPOSER} AS composer_id, {TITLE} AS title FROM part",
    # works with UUID, generic, missing and padded titles, and a second copy of many rows
    "raw_dirty_works": f"""
SELECT CAST(p_partkey AS BIGINT) AS work_id, {COMPOSER} AS composer_id, {DIRTY_TITLE} AS title, {TITLE} AS full_title FROM part
UNION ALL SELECT CAST(p_partkey + 50000000 AS BIGINT), {COMPOSER}, {DIRTY_TITLE}, {TITLE} FROM part WHERE p_size > 45""",
    # works whose title names the composer when the link is missing
    "raw_named_works": f"""
SELECT CAST(p_partkey AS BIGINT) AS work_id, {COMPOSER} AS composer_id,
  CASE WHEN p_partkey % 13 = 12 AND s_name IS NOT NULL THEN concat(s_name, ': ', {TITLE}) ELSE {TITLE} END AS title
FROM part LEFT JOIN supplier ON s_suppkey = CASE WHEN p_partkey % 13 = 12 THEN p_partkey % 10 END AND p_size < 40""",
    "raw_composers": """
SELECT CAST(s_suppkey AS BIGINT) AS composer_id, s_name AS name, n_name AS country,
  CAST(1380 + (s_suppkey * 67) % 600 AS INT) AS birth_year,
  CASE WHEN s_suppkey % 5 = 4 THEN NULL
       ELSE CAST(1380 + (s_suppkey * 67) % 600 + 40 + s_suppkey % 45 AS INT) END AS death_year
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
    # two tag sources, untagged works (small sizes), low confidence, orphans
    "tags": """
SELECT CAST(p_partkey AS BIGINT) AS work_id,
  CASE p_type WHEN 'ECONOMY' THEN 'lyrical' WHEN 'PROMO' THEN 'romantic' WHEN 'LARGE' THEN 'full-orchestra'
    WHEN 'SMALL' THEN 'solo-piano' WHEN 'STANDARD' THEN 'classical' ELSE 'virtuosic' END AS tag,
  'musicbrainz' AS source, CAST(1.0 AS DOUBLE) AS confidence
  FROM part WHERE p_size > 12
UNION ALL SELECT CAST(p_partkey AS BIGINT),
  CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'passionate' WHEN 'large' THEN 'grand' WHEN 'blue' THEN 'melancholic'
    WHEN 'new' THEN 'modern' WHEN 'cold' THEN 'dark' WHEN 'small' THEN 'intimate' WHEN 'hot' THEN 'energetic'
    ELSE 'romantic' END, 'auto-tagger', CAST((p_size % 10) / 10.0 AS DOUBLE) FROM part WHERE p_size BETWEEN 8 AND 30
UNION ALL SELECT CAST(p_partkey AS BIGINT), split_part(p_name, ' ', 2), 'auto-tagger', CAST(0.9 AS DOUBLE)
  FROM part WHERE p_size BETWEEN 8 AND 30
UNION ALL SELECT CAST(s_suppkey + 100000000 AS BIGINT), 'orphan', 'test', CAST(1.0 AS DOUBLE) FROM supplier""",
    "history": """
SELECT o_custkey AS user_id, l_partkey AS work_id, o_orderpriority AS vibe, o_orderdate AS saved_at,
  CAST(l_linenumber AS INT) AS rank, l_discount AS relevance_score,
  CAST(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS INT) AS rating, o_orderkey AS seq
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    # the query log: what users typed, with an activity word in front
    "query_log": """
SELECT conv_id * 1000 + turn AS query_id,
  CASE conv_id % 9 WHEN 0 THEN 'studying' WHEN 1 THEN 'Dinner Party' WHEN 2 THEN 'rainy morning' WHEN 3 THEN 'sad girl'
    WHEN 4 THEN 'E minor, dramatic' WHEN 5 THEN 'romantic and dark' WHEN 6 THEN 'Baroque calm' WHEN 7 THEN 'grand G major'
    ELSE 'plain' END AS activity,
  CASE WHEN turn = 2 THEN '' ELSE text END AS context
FROM conversations WHERE role = 'user'""",
}

DEPENDS = {
    "works": ["raw_works"], "dirty_works": ["raw_dirty_works"], "named_works": ["raw_named_works"],
    "composers": ["raw_composers"],
}


def _ascii(p: str) -> bool:
    return all(ord(ch) < 128 for ch in p)


def _re2(p: str) -> str:
    """The pattern without look-ahead and non-ASCII alternatives, which the checking engine lacks."""
    return re.sub(r"\(\?![^)]*\)", "", p).replace("'", "''")


def _case(rules, out) -> str:
    whens = " ".join(f"WHEN regexp_matches({{t}}, '{_re2(p)}', 'i') THEN {out(p, v)}" for p, v in rules)
    return f"CASE {whens} END"


def sql_catalog_number(t: str) -> str:
    return _case(CATALOG_NUMBER_PATTERNS,
                 lambda p, v: f"concat('{v} ', trim(regexp_extract({{t}}, '{_re2(p)}', 1, 'i')))").format(t=t)


def all_rules():
    return [*KNOWN_TITLES, *[(p, n) for n, ps in WORK_TYPE_PATTERNS for p in ps]]


def work_type_rules():
    rules = [(p, n) for p, n in KNOWN_TITLES if _ascii(p)]
    return rules + [(p, n) for n, ps in WORK_TYPE_PATTERNS for p in ps if _ascii(p)]


def sql_work_type(t: str) -> str:
    return _case(work_type_rules(), lambda p, v: f"'{v}'").replace("{t}", t)


def sql_key(t: str) -> str:
    def note(p, flag):
        raw = f"regexp_extract({t}, '{p}', 1{flag})"
        rest = f"lower(substr({raw}, 2))"
        return (f"concat(upper(substr({raw}, 1, 1)), CASE WHEN {rest} LIKE '%#%' OR {rest} LIKE '%♯%' OR {rest} LIKE '%-sharp%' "
                f"THEN '♯' WHEN {rest} LIKE '%b%' OR {rest} LIKE '%♭%' OR {rest} LIKE '%-flat%' THEN '♭' ELSE '' END)")
    i = ", 'i'"
    mode = f"lower(regexp_extract({t}, '{KEY_STANDARD}', 2{i}))"
    return (f"CASE WHEN regexp_matches({t}, '{KEY_GERMAN}') THEN concat({note(KEY_GERMAN, '')}, "
            f"CASE WHEN lower(regexp_extract({t}, '{KEY_GERMAN}', 2)) = 'dur' THEN ' major' ELSE ' minor' END) "
            f"WHEN regexp_matches({t}, '{KEY_STANDARD}'{i}) THEN concat({note(KEY_STANDARD, i)}, "
            f"CASE WHEN {mode} IN ('minor', 'min', 'moll') THEN ' minor' ELSE ' major' END) "
            f"WHEN regexp_matches({t}, '{KEY_SHORT_MAJOR}') THEN concat({note(KEY_SHORT_MAJOR, '')}, ' major') "
            f"WHEN regexp_matches({t}, '{KEY_SHORT_MINOR}') THEN concat({note(KEY_SHORT_MINOR, '')}, ' minor') END")


def sql_period(b: str = "birth_year", d: str = "death_year") -> str:
    ref = f"(CASE WHEN {d} <> 0 THEN {b} + CAST(floor(({d} - {b}) / 2.0) AS INT) ELSE {b} + 40 END)"
    whens = " ".join(
        "WHEN " + " AND ".join(([f"{ref} >= {s}"] if s is not None else []) + ([f"{ref} < {e}"] if e is not None else []))
        + f" THEN '{n}'" for n, s, e in PERIODS)
    return f"CASE WHEN {b} IS NOT NULL AND {b} <> 0 THEN CASE {whens} END END"


def _sql(name: str) -> str:
    if name in ("works", "dirty_works", "named_works"):
        t = "full_title" if name == "dirty_works" else "title"
        cols = "work_id, composer_id, title" if name == "dirty_works" else "*"
        return (f"SELECT {cols}, {sql_catalog_number(t)} AS catalog_number, {sql_work_type(t)} AS work_type, "
                f"{sql_key(t)} AS key FROM {DEPENDS[name][0]}")
    if name == "composers":
        return f"SELECT *, {sql_period()} AS period FROM raw_composers"
    return RAW[name]


def with_ctes(*names: str, extra: dict[str, str] | None = None) -> str:
    """WITH clause defining the named views (and their inputs), then the extra ones."""
    order: list[str] = []
    for n in names:
        for need in [*DEPENDS.get(n, []), n]:
            if need not in order:
                order.append(need)
    parts = [f"{n} AS MATERIALIZED ({_sql(n)})" for n in order]
    parts += [f"{n} AS MATERIALIZED ({q})" for n, q in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n"


class Tables:
    """The views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _raw(self, name: str) -> DataFrame:
        text = RAW[name]
        used = [t for t in BASE_TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", text)]
        for t in used:
            text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
        return self.spark.sql(text, **{t: self.base(t) for t in used})

    def _kept(self, name: str, sources: str, build, key: str = "work_id", ranged: bool = False) -> DataFrame:
        """A derived table stored for this folder's files, sorted by work; built by the first query that needs it."""
        folder = f"{shared_folder(self.spark).rstrip('/')}/catalogue/{hashlib.md5(self.folder.encode()).hexdigest()}/{name}"
        return kept(self.spark, folder, "1", [self.base(t) for t in sources.split()], build, key, ranged=ranged)

    # Works are parsed once and stored, as the conforming job does; queries then scan the stored columns.
    # They are spread before the parse: a file of part is small, but each title costs many patterns.
    @cached_property
    def works(self) -> DataFrame:
        return self._kept("works", "part", lambda: enrich_titles(spread(self._raw("raw_works"), "work_id")), ranged=True)

    @cached_property
    def features(self) -> DataFrame:
        from ostinato.operators.features import feature_rows, tag_tfidf

        return self._kept("features", "part supplier nation", lambda: feature_rows(self.works, self.composers, tag_tfidf(self.works, self.tags)[0]))

    @cached_property
    def cards(self) -> DataFrame:
        from ostinato.operators.recommend import cards

        return self._kept("cards", "part supplier nation", lambda: cards(self.works, self.composers, self.tags))

    @cached_property
    def raw_works(self) -> DataFrame:
        return self._raw("raw_works")

    @cached_property
    def dirty_works(self) -> DataFrame:
        return cut(enrich_titles(spread(self._raw("raw_dirty_works"), "work_id"), "full_title").drop("full_title"), "dirty-works")

    @cached_property
    def named_works(self) -> DataFrame:
        return cut(enrich_titles(spread(self._raw("raw_named_works"), "work_id")), "named-works")

    @cached_property
    def composers(self) -> DataFrame:
        return self._raw("raw_composers").withColumn("period", period_of("birth_year", "death_year"))

    @cached_property
    def tags(self) -> DataFrame:
        return self._raw("tags")

    @cached_property
    def history(self) -> DataFrame:
        return self._raw("history")

    @cached_property
    def query_log(self) -> DataFrame:
        return self._raw("query_log")

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.base("embeddings")

    @cached_property
    def events(self) -> DataFrame:
        return self.base("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def documents(self) -> DataFrame:
        return self.base("documents")
