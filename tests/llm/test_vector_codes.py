import hashlib
import math
import random

import numpy as np
import pytest

from ostinato.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=16, rounds=2):
    """(vec_id, code, error, label) of every usable row, and the digest, by comparing all with all."""
    good = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good = [(i, [max(-2**63, min(2**63 - 1, x)) for x in v], label) for i, v, label in good]
    ids = sorted({i for i, _, _ in good if i is not None})
    length = len(min(v for i, v, _ in good if i == ids[0])) if ids else None
    fit = [g for g in good if ids and len(g[1]) == length and length % parts == 0]
    out = [(i, None, None, label) for i, v, label in good if not (ids and len(v) == length and length % parts == 0)]
    if not fit:
        return out, vector_codes.books_digest([])
    width, first = length // parts, {}
    for i, v, _ in fit:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    first = [first[i] for i in sorted(first)[:64]]
    books = [[v[p * width:(p + 1) * width] for v in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            cells = [v[p * width:(p + 1) * width] for _, v, _ in fit]
            groups = {}
            for c in cells:
                groups.setdefault(nearest(c, book)[1], []).append(c)
            for j, g in groups.items():
                book[j] = [sum(x) // len(g) for x in zip(*g)]
    for i, v, label in fit:
        found = [nearest(v[p * width:(p + 1) * width], b) for p, b in enumerate(books)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), min(2**63 - 1, sum(d for d, _ in found)), label))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS id", "1 AS v", "2 AS code", "3 AS l")
    got = vector_codes.digest(*vector_codes.compress(df.repartition(3), **kw)).collect()
    expected, mark = brute(rows, **kw)
    sums = {}
    for _, _, error, label in expected:
        if error is not None:
            sums[label] = min(2**63 - 1, sums.get(label, 0) + error)
    expected = [(i, code, error, sums.get(label), mark) for i, code, error, label in expected]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    check(spark, [(i, rng.normal(size=32).tolist(), int(i % 3) or None) for i in range(300)])
    check(spark, [(i, rng.normal(size=12).tolist(), 1) for i in range(90)], parts=4, rounds=3)


def test_ties_and_far_points(spark):
    rnd = random.Random(5)
    rows = [(i, [float(rnd.choice([-1, 0, 1])) for _ in range(16)], i % 2) for i in range(150)]
    check(spark, rows + [(1000, [1e4] * 16, 0), (1001, [-1e4] * 15 + [3.0], 0)])


def test_odd_rows(spark):
    good = [0.5 * i for i in range(16)]
    rows = [(5, good, None), (5, good[::-1], 1), (5, good, None), (None, good[::-1], None), (7, None, 1), (8, good[:15] + [None], 1), (9, good[:15] + [float("nan")], 2),
            (10, good[:15] + [float("inf")], 2), (11, good * 2, 3), (12, [], 3), (13, good[:3], None)]
    check(spark, rows)
    check(spark, [(None, good, 1)])
    check(spark, [(1, [], 1), (2, [], None), (3, [1.0], 2)])
    check(spark, [(1, [1.0] * 5, 1)])


def test_huge_components(spark):
    rows = [(i, [(-1.0) ** i * 10.0 ** (i % 38)] * 16, 1) for i in range(100)]
    check(spark, rows)


def test_empty(spark):
    codes, books = vector_codes.compress(spark.createDataFrame([], SCHEMA))
    assert vector_codes.digest(codes, books).collect() == [] and books == []


@pytest.mark.parametrize("radius", [1, 10**6])
def test_any_first_radius(radius):
    rng = np.random.default_rng(radius)
    book = vector_codes.Sliced(rng.integers(-200, 200, (64, 4)).tolist())
    book.radius = radius
    parts = rng.integers(-300, 300, (500, 4))
    index, best = book.nearest(parts)
    gaps = ((parts[:, None] - book.entries[None]) ** 2).sum(axis=2)
    assert (index == gaps.argmin(axis=1)).all() and (best == gaps.min(axis=1)).all()
