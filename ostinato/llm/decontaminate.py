"""Benchmark decontamination with Aho-Corasick automata.

All runs of ``window`` words of the benchmark items become patterns of one automaton, which scans each text once; a benchmark
beyond ``MAX_WINDOW_BYTES`` is dealt to automata of bounded size by the hash of window and item.
Patterns are whole words between blanks, so a match starts and ends at words; match ends lead back to word numbers and
these to code-point offsets of the original text.

Null or wordless items have no windows, null or wordless texts no words and no hits. Repeated items count once for each
item_id; repeated documents are judged one by one. Columns of the input stay; those named like a result are replaced.
"""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.common import text_or_empty, with_fields, worker_cached
from ostinato.session import cut

#: Words before folding: the contract's class, with A-Z.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A-Z to a-z; digits, a-z and all bytes of characters beyond ASCII stay; the rest parts words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: The automaton needs some hundred bytes a window character in each worker.
MAX_WINDOW_BYTES = 32 << 20
RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
FIELDS = ["n_words", "n_hit", "items", "spans"]


def folded_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows_of(items, window: int) -> dict[str, tuple[int, list[str]]]:
    """``{' w1 w2 .. ': (number of words, sorted item ids)}``."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item_id, text in items:
        words = [w.decode("utf-8", "surrogatepass") for w in folded_words(text or "")]
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            found.setdefault(f" {' '.join(words[i:i + size])} ", (size, set()))[1].add(str(item_id))
    return {k: (n, sorted(ids)) for k, (n, ids) in found.items()}


def matcher(windows: dict[str, tuple[int, list[str]]]):
    """A function from folded words to (ranges of hit words, item ids)."""
    import ahocorasick
    import numpy as np

    automaton = ahocorasick.Automaton()
    sizes, owners = [], []
    for k, (n, ids) in windows.items():
        automaton.add_word(k, len(sizes))
        sizes.append(n)
        owners.append(ids)
    if sizes:
        automaton.make_automaton()
    sizes = np.array(sizes)

    def match(words: list[bytes]):
        if not words or not len(sizes):
            return [], []
        hay = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
        found = list(automaton.iter(hay))
        if not found:
            return [], []
        blanks = np.flatnonzero(np.frombuffer(hay.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) == 32)
        ends, which = np.array(found, dtype=np.int64).T
        after = np.searchsorted(blanks, ends)
        return joined(zip((after - sizes[which]).tolist(), after.tolist())), sorted({i for w in set(which.tolist()) for i in owners[w]})

    return match


def joined(ranges) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


WORDS_AT = re.compile(WORD)


def judged(text: str, n_words: int, ranges: list[tuple[int, int]], items: list[str]):
    """(n_words, n_hit, item ids, spans) of a text with hit words."""
    if not ranges:
        return n_words, 0, [], []
    place = [(m.start(), m.end()) for m in WORDS_AT.finditer(text)]
    return n_words, sum(b - a for a, b in ranges), items, [(place[a][0], place[b - 1][1]) for a, b in ranges]


def result_frame(rows) -> pd.DataFrame:
    return pd.DataFrame({"n_words": [r[0] for r in rows], "n_hit": [r[1] for r in rows], "items": [r[2] for r in rows],
                         "spans": [[{"start": a, "end": b} for a, b in r[3]] for r in rows]})


def scanned_at_once(docs: DataFrame, items: DataFrame, window: int, text: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])
    token = uuid.uuid4().hex

    @F.pandas_udf(RESULT)
    def scan_texts(texts: pd.Series) -> pd.DataFrame:
        match = worker_cached("decontaminate", token, lambda: matcher(windows_of(sent.value, window)))
        rows = []
        for t in texts:
            words = folded_words(t)
            rows.append(judged(t, len(words), *match(words)))
        return result_frame(rows)

    return docs.withColumn("_scan", scan_texts(text_or_empty(text)))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """``pattern, n, item`` of all windows of all items."""
    def cut_up(batches):
        import pyarrow as pa

        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w.decode("utf-8", "surrogatepass") for w in folded_words(text or "")]
                n = min(window, len(words))
                for at in range(0, len(words) - n + 1 if n else 0, 4096):
                    made = [f" {' '.join(words[i:i + n])} " for i in range(at, min(at + 4096, len(words) - n + 1))]
                    yield pa.RecordBatch.from_pydict({"pattern": made, "n": [n] * len(made), "item": [str(item)] * len(made)})

    return items.mapInArrow(cut_up, "pattern string, n long, item string")


def part_matches(sent):
    token = uuid.uuid4().hex

    @F.pandas_udf("ranges array<struct<a:int,b:int>>, items array<string>")
    def match_texts(texts: pd.Series) -> pd.DataFrame:
        match = worker_cached("decontaminate", token, lambda: matcher(sent.value))
        out = [match(folded_words(t)) for t in texts]
        return pd.DataFrame({"ranges": [[{"a": a, "b": b} for a, b in r[0]] for r in out], "items": [r[1] for r in out]})

    return match_texts


def scanned_in_parts(docs: DataFrame, items: DataFrame, window: int, text: str) -> DataFrame:
    """The same with an automaton for each part of the windows, one after another; what the parts hit is united by document."""
    spark = docs.sparkSession
    rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")
    windows = cut(item_windows(items, window).distinct(), "windows")
    size = windows.agg(F.sum(F.octet_length("pattern") + F.octet_length("item"))).first()[0] or 0
    parts = 1 + 2 * size // MAX_WINDOW_BYTES
    windows = cut(windows.withColumn("part", F.pmod(F.xxhash64("pattern", "item"), F.lit(parts))), "windows")
    hits = None
    for part in range(parts):
        found: dict[str, tuple[int, list[str]]] = {}
        for pattern, n, item in windows.where(F.col("part") == part).select("pattern", "n", "item").collect():
            found.setdefault(pattern, (n, []))[1].append(item)
        sent = spark.sparkContext.broadcast(found)
        new = cut(rows.select("_row", part_matches(sent)(text_or_empty(text)).alias("_m")).where(F.size("_m.items") > 0).select("_row", "_m.ranges", "_m.items"), "hits")
        hits = new if hits is None else hits.unionByName(new)
        sent.unpersist()
    hits = hits.groupBy("_row").agg(F.flatten(F.collect_list("ranges")).alias("_ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("_items"))

    @F.pandas_udf(RESULT)
    def unite(texts: pd.Series, ranges: pd.Series, names: pd.Series) -> pd.DataFrame:
        return result_frame([judged(t, len(folded_words(t)), [] if r is None else joined((x["a"], x["b"]) for x in r), [] if i is None else sorted(i))
                             for t, r, i in zip(texts, ranges, names)])

    both = rows.join(hits, "_row", "left")
    return both.withColumn("_scan", unite(text_or_empty(text), "_ranges", "_items")).drop("_row", "_ranges", "_items")


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, text: str = "text",
                       item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents with n_words, n_hit, items (sorted as strings), spans and contaminated.

    A word is hit if it lies in any occurrence of a window; a document is contaminated if ``share * n_hit >= n_words``
    and there is a hit. A benchmark too large for one automaton is dealt to several, which scan the texts in turn.
    """
    items = items.select(item_id, item_text)
    size = items.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    scan = scanned_at_once if size * window <= MAX_WINDOW_BYTES else scanned_in_parts
    found = with_fields(scan(docs, items, window, text), "_scan", FIELDS)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    """Result rows of the query."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: The same rows by window joins.
ORACLE = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i + 1 : i + least(len(w), 13)], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 12, 1))) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM item_windows),
doc_windows AS (
  SELECT r, i, k, array_to_string(w[i + 1 : i + k], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM doc_words, sizes WHERE len(w) >= k)),
found AS (SELECT d.r, d.i, d.k, t.item_id FROM doc_windows d JOIN item_windows t ON d.g = t.g AND d.k = t.k),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM found)) GROUP BY r),
owners AS (SELECT r, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hits USING (r) LEFT JOIN owners USING (r)"""
