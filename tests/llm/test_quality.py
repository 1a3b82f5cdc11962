import numpy as np
import zlib
from helpers import LONG, docs_frame, with_odd_rows

from ostinato.llm import quality

WORDS = "The of and to in is that for it was on are as with his they at be this from have or by one had not but what all were".split()


def corpus():
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for i in range(300):
        words = [str(w) for w in rng.choice(WORDS, 60)]
        bad = i % 4 == 0
        texts.append(" ".join(w + "$$$" for w in words) if bad else " ".join(words) + ".")
        labels.append((i, 0 if bad else 1))
    return texts + [None, "", LONG], labels


def test_learns_and_scores_all(spark):
    texts, labels = corpus()
    docs = with_odd_rows(docs_frame(spark, texts, {"score": "x", "held_out": 3, "predicted": "y"}), spark)
    marks = spark.createDataFrame([*labels, labels[0], (None, 1), (5, None), (9999, 0)], "doc_id long, quality int")
    rows = quality.score(docs, marks).collect()
    assert len(rows) == len(texts) + 2
    truth = dict(labels)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id in truth:
            assert r.predicted == truth[r.doc_id]
    assert quality.score(docs.limit(0), marks).count() == 0


def test_without_labels_or_with_one_class(spark):
    docs = docs_frame(spark, ["a b c", None])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, none).collect()] == [0.5, 0.5]
    ones = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in quality.score(docs, ones).collect())


def test_held_out_labels_change_nothing(spark):
    texts, labels = corpus()
    docs = docs_frame(spark, texts)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    models = [quality.learn(docs, spark.createDataFrame(m, "doc_id long, quality int")) for m in (labels, flipped)]
    assert models[0] == models[1]


def test_columns_are_the_rules(spark):
    texts, labels = corpus()
    docs = docs_frame(spark, texts)
    start, rules = quality.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    names = list(quality.statistics())
    rows = docs.select(quality.compiled(start, rules, lambda n: quality.statistics()[n]).alias("s"),
                       *[c.cast("double").alias(n) for n, c in quality.statistics().items()]).collect()
    x = np.array([r[1:] for r in rows])
    z = start + sum(w * quality.holds(r, x, names) for w, r in rules)
    assert np.allclose([r.s for r in rows], 1 / (1 + np.exp(-z))) and rules


def test_filter_on_the_score_computes_each_statistic_once(spark):
    texts, labels = corpus()
    scored = quality.score(docs_frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int"))
    good = scored.where("predicted = 1").select("doc_id")
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    tests = [line for line in plan.splitlines() if "Filter" in line]
    assert tests and not any("regexp" in line or "split(" in line for line in tests), plan
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scored.collect() if r.predicted == 1}
