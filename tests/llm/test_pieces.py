from collections import Counter

import numpy as np
import pytest
from helpers import LONG, docs_frame, with_odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ostinato.llm import pieces

PATH = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
TEXTS = ["Hello world", None, "", " ", "  a  b", "▁ literal ▁x", "line\nfeed\ttab\r", "日本語😀", "a" * 3000, "😀" * 300, LONG, "\x00", "é" * 100 + " x"]


@pytest.fixture(scope="module")
def lattices():
    return pieces.Lattices(pieces.Model(PATH, 1.0))


def encode(lattices, texts, seed=0):
    return pieces.encode_texts(lattices, texts, pieces.mixed(np.arange(len(texts), dtype=np.uint64) + np.uint64(seed << 20)))


def test_round_trip_and_reproducible(spark):
    docs = with_odd_rows(docs_frame(spark, TEXTS, {"ids": "x", "n_pieces": "y", "decoded": 1}), spark)
    first = pieces.encode_pieces(docs, PATH, F.col("doc_id"))
    again = {r.doc_id: r.ids for r in pieces.encode_pieces(docs.repartition(7), PATH, F.col("doc_id")).collect()}
    other = {r.doc_id: r.ids for r in pieces.encode_pieces(docs, PATH, F.col("doc_id"), seed=1).collect()}
    rows = pieces.decode_pieces(first, PATH, name="decoded").collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert r.decoded == (r.text or "") and r.n_pieces == len(r.ids) and r.ids == again[r.doc_id]
    assert other[10] != again[10]
    assert pieces.encode_pieces(docs.limit(0), PATH, F.col("doc_id")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_lossless(lattices, texts):
    for ids, t in zip(encode(lattices, texts), texts):
        assert lattices.model.text_of(ids)[1:].decode() == t


def segmentations(model, unit):
    if not unit:
        yield (), 1.0
    for k in range(1, len(unit) + 1):
        i, w = model.prefixes.get(unit[:k], (-1, 0.0))
        if i >= 0:
            for rest, v in segmentations(model, unit[k:]):
                yield (i, *rest), w * v


@pytest.mark.parametrize("alpha", [1.0, 0.3])
def test_sampled_as_the_lattice_says(alpha):
    own = pieces.Lattices(pieces.Model(PATH, alpha))
    weights = dict(segmentations(own.model, " these"))
    total = sum(weights.values())
    seen = Counter(tuple(i.tolist()) for i in encode(own, ["these"] * 20000))
    assert set(seen) <= set(weights)
    assert sum(abs(seen[k] / 20000 - w / total) for k, w in weights.items()) < 0.06


def test_filters_agree(lattices):
    for unit in (" thanks", "these", "  ", " Donaudampf", "x"):
        one, many = pieces.Lattices(lattices.model), pieces.Lattices(lattices.model)
        end = one.filter(unit)
        assert many.filter_many([unit]) == [] and many.known[unit] == end and many.used == one.used
        a, b = np.lexsort((one.pieces[:one.used], one.before[:one.used])), np.lexsort((many.pieces[:many.used], many.before[:many.used]))
        assert sorted(zip(one.before[a], one.pieces[a])) == sorted(zip(many.before[b], many.pieces[b]))


def test_small_chunks_change_nothing(lattices, monkeypatch):
    texts = [t or "" for t in TEXTS]
    whole = encode(lattices, texts)
    monkeypatch.setattr(pieces, "CHUNK", 5)
    monkeypatch.setattr(pieces, "EDGES", 100)
    assert all((a == b).all() for a, b in zip(whole, encode(pieces.Lattices(lattices.model), texts)))
