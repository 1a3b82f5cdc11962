import hashlib
import re

from helpers import LONG, docs_frame, with_odd_rows

from ostinato.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, items, window=13):
    words = WORD.findall((text or "").translate(LOWER))
    hit, owners = set(), set()
    for item_id, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i:i + n]) in windows:
                hit.update(range(i, i + n))
                owners.add(str(item_id))
    return len(words), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


A = "What is the Capital of the largest country on Earth, by area? It is Moscow é."
ITEMS = [(1, A), (2, "short Item"), (10, A), (3, None), (4, "..."), (5, "x x x x x x x x x x x x x x x")]
TEXTS = [A, f"Zoë said: {A.upper().replace('É', 'é')} End.", "short item SHORT-item", None, "", "x " * 40, LONG, f"{LONG} {A}", "Short Item", "nothing"]


def test_against_brute_force(spark):
    docs = with_odd_rows(docs_frame(spark, TEXTS, {"n_words": -1, "spans": "x"}), spark)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.find_contamination(docs, items)
    assert found.columns.count("n_words") == 1 and "source" in found.columns
    rows = decontaminate.digest(found).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = None if r.doc_id is None else TEXTS[r.doc_id]
        assert tuple(r)[1:] == brute(text, ITEMS), r.doc_id


def test_spans_are_in_the_original(spark):
    docs = docs_frame(spark, [f"Zoë: {A} End", "a Short, ITEM b"])
    items = spark.createDataFrame([(1, A), (2, "short item")], "item_id long, text string")
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in decontaminate.find_contamination(docs, items).collect()}
    assert spans == {0: [(5, 5 + len(A) - 1)], 1: [(2, 13)]}


def test_empty_tables(spark):
    docs, none = docs_frame(spark, ["a b"]), spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.find_contamination(docs, none).collect()] == [0]
    assert decontaminate.find_contamination(docs.limit(0), none).count() == 0


def test_benchmark_beyond_one_automaton(spark, monkeypatch):
    docs = with_odd_rows(docs_frame(spark, TEXTS), spark)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = sorted(map(str, decontaminate.find_contamination(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "MAX_WINDOW_BYTES", 600)
    found = decontaminate.find_contamination(docs, items)
    assert sorted(map(str, found.collect())) == whole
    for r in decontaminate.digest(found).collect():
        assert tuple(r)[1:] == brute(None if r.doc_id is None else TEXTS[r.doc_id], ITEMS), r.doc_id
