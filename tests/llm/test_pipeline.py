import os

import pytest

import corpus_pipeline
from ostinato.llm import pieces
from ostinato.llm.queries import ORACLES, QUERIES
from ostinato.session import cut

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {n[:n.index("_") + 1] for n in QUERIES if n.startswith("op")}
    assert set(QUERIES) <= names and set(ORACLES) <= set(QUERIES) and "pipeline" in names


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_stages(spark):
    import public_tokenizers

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept, columns = [set(r.doc_id for r in docs.collect())], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, FOLDER), name)
        kept.append(set(r.doc_id for r in docs.select("doc_id").collect()))
        assert kept[-1] <= kept[-2]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert len(kept[4]) == len(kept[3]) == len(kept[5]) > 0.5 * len(kept[0])
    rows = pieces.decode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), name="back").collect()
    assert all(r.back == r.text and len(r.text) == r.n_chars for r in rows)
    assert {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()} == kept[5]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, FOLDER), name)
        assert docs.count() == 0


def similar_roots(texts: dict, size: int = 5, least: float = 0.8) -> dict:
    """Smallest id of each group of similar texts, by comparing all pairs of shingle sets."""
    def shingles(text):
        words = (text or "").encode().lower().split()
        return frozenset(b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()

    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x == y or (x and y and min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y)):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_stages_against_plain_twins(spark):
    """Each stage's decisions, on its own input, against plain Python."""
    import numpy as np
    from test_decontaminate import brute as windows
    from test_private import brute as base_spans

    from ostinato.llm import quality

    docs = cut(spark.read.parquet(f"{FOLDER}/documents.parquet"), "documents")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)

    def next_stage(name):
        return cut(stages[name](spark, docs, FOLDER), name)

    def texts(df):
        return {r.doc_id: r.text for r in df.collect()}

    # the rules, applied in arrays to the statistics
    start, rules = quality.learn(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    stats = quality.statistics("text")
    rows = docs.select("doc_id", *[c.cast("double").alias(n) for n, c in stats.items()]).collect()
    x = np.array([list(r)[1:] for r in rows])
    total = start + sum(w * quality.holds(rule, x, list(stats)) for w, rule in rules)
    score = {r.doc_id: 1 / (1 + np.exp(-t)) for r, t in zip(rows, total)}
    kept = next_stage("quality")
    assert set(texts(kept)) == {i for i, v in score.items() if v >= 0.3}
    docs = kept

    kept = next_stage("near_duplicates")
    roots = similar_roots(texts(docs))
    assert set(texts(kept)) == set(roots.values()) and len(set(roots.values())) < len(roots)
    docs = kept

    kept = next_stage("decontamination")
    found = {i: windows(t, items) for i, t in texts(docs).items()}
    assert set(texts(kept)) == {i for i, f in found.items() if not f[-1]}
    docs = kept

    masked, before = texts(next_stage("private_data")), texts(docs)
    assert set(masked) == set(before)
    for i, text in before.items():
        for a, _kind, b in base_spans(text):
            assert b - a < 8 or text[a:b] not in masked[i], (i, text[a:b])
    assert sum(masked[i] != (before[i] or "") for i in before) < len(before)
