import numpy as np
import xxhash
from helpers import LONG, docs_frame, with_odd_rows
from pyspark.sql import functions as F

from ostinato.llm import graph, simhash


def brute_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values):
    """Smallest value reachable by steps of at most two bits (signed longs)."""
    values = sorted(set(values))
    at = np.array(values, dtype=np.int64).view(np.uint64)
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(at[i + 1:] ^ at[i]) <= 2):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return {v: values[find(i)] for i, v in enumerate(values)}


def roots_by_links(spark, values):
    df = spark.createDataFrame([(v,) for v in sorted(set(values))], "bits long")
    found = {r.node: r.root for r in graph.components(simhash.links(df)).collect()}
    return {v: found.get(v, v) for v in values}


def signed(values):
    return np.array(values, dtype=np.uint64).view(np.int64).tolist()


def test_links_in_small_and_large_buckets(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    near = [b ^ (1 << int(i)) ^ (1 << int(j)) ^ (1 << int(k) if rng.random() < .5 else 0) for b in base for i, j, k in rng.integers(0, 64, (4, 3))]
    dense = [0xF0F0 << 20]
    for _ in range(700):  # a walk whose fingerprints share most segments: buckets beyond the pair bound
        dense.append(dense[int(rng.integers(0, len(dense)))] ^ (1 << int(rng.integers(0, 12))) ^ (1 << int(rng.integers(40, 52))))
    values = signed(base + near + dense + [0, 1, 3, 7, (1 << 64) - 1, (1 << 64) - 2])
    assert roots_by_links(spark, values) == {v: r for v, r in brute_roots(values).items()}


def test_chain_filter_is_complete(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(x), int(x) ^ (1 << int(i)) ^ (1 << int(j))) for x in rng.integers(0, 1 << 63, 300) for i, j in rng.integers(0, 64, (1, 2))]
    df = spark.createDataFrame([tuple(signed(p)) for p in pairs], "a long, b long")
    common = F.array_intersect(simhash.chain_keys(F.col("a")), simhash.chain_keys(F.col("b")))
    held = F.exists(common, lambda k: simhash.chain_holds(k, F.col("a"), F.col("b")))
    assert df.where(~held).count() == 0


def test_groups_against_brute_force(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from all of the other animals in the wood"
    texts = [text, text.upper(), text + "\t", "\x0b one  two ", "one two", None, "", "   ", "É é Ü words", "é É ü words", LONG, LONG + " x", "a b c d", "b c d e", "solo"] + [f"{text} {i}" for i in range(6)]
    docs = with_odd_rows(docs_frame(spark, texts, {"fingerprint": 1, "component_id": 2}), spark)
    rows = simhash.near_groups(docs).collect()
    assert len(rows) == len(texts) + 2
    prints = signed([brute_fingerprint(t) for t in texts])
    roots = brute_roots(prints + [0])
    first = {}
    for i, p in enumerate(prints):
        first.setdefault(roots[p], i)
    for r in rows:
        p = 0 if r.doc_id is None else prints[r.doc_id]
        assert (r.fingerprint, r.component_id) == (f"{p & (1 << 64) - 1:016x}", first[roots[p]])
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_long_texts_in_parts(monkeypatch):
    whole = simhash.fingerprint(LONG)
    monkeypatch.setattr(simhash, "PART_WORDS", 7)
    assert simhash.fingerprint(LONG) == whole == brute_fingerprint(LONG)


def jaccard(a, b, size=5):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / max(1, len(x | y))


def test_similar_texts_keep_one(spark):
    rng = np.random.default_rng(3)
    texts = []
    for g in range(30):
        words = [f"w{int(x)}" for x in rng.integers(0, 10**6, 150)]
        texts.append(" ".join(words))
        texts.append(" ".join(words[:75] + ["changed"] + words[76:]))  # similarity 0.93
        texts.append(" ".join("z" if i % 9 == 0 else w for i, w in enumerate(words)))  # far below 0.8
    texts += [texts[0], texts[0].upper(), None, "", "tiny"]
    docs = docs_frame(spark, texts, {"component_id": 1})
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect())
    expected = [i for i, t in enumerate(texts) if not any(jaccard(t, texts[j]) >= 0.8 or (t or "") == (texts[j] or "") for j in range(i))]
    assert kept == expected
    nulls = spark.range(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields])
    assert simhash.drop_near_duplicates(docs.limit(0).unionByName(nulls)).count() == 2


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(159, 200), (300, 300), (400, 401), (401, 400), (None, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in [*range(101, 160), 200]}, 401: 400}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shared_hashes(rng, n, count, kept):
    """Hashes of ``count`` unrelated pairs of long texts; ``kept`` of the second text's shingles come from the first."""
    for _ in range(count):
        a, b = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64) * np.uint64(2)
        yield a, np.concatenate([a[:int(kept * n)], b[int(kept * n):]])


def test_sketches_of_very_long_texts(monkeypatch):
    rng = np.random.default_rng(8)
    multipliers = rng.integers(0, 1 << 31, simhash.SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    monkeypatch.setattr(simhash, "shingle_hashes", lambda hashes, size: [hashes])

    def sketch(hashes):
        return np.frombuffer(simhash.sketch(hashes, 5, multipliers)[1], dtype="<u2")

    for n in (20_000, 120_000, 300_000):
        alone, near = [], []
        for a, b in shared_hashes(rng, n, 3, 0):
            alone += [sketch(a), sketch(b)]
        for a, b in shared_hashes(rng, n, 2, 0.9):  # similarity 0.9 / 1.1
            near.append((sketch(a) == sketch(b)).mean())
        assert max((alone[i] == alone[j]).mean() for i in range(6) for j in range(i)) < 0.03
        assert all(0.66 < x < 0.96 for x in near)
        assert len({x[i:i + 4].tobytes() for x in alone for i in range(0, 64, 4)}) == 6 * 16


def test_pairs_inside_families_of_one_template(spark):
    rng = np.random.default_rng(12)
    template, texts = [f"t{i}" for i in range(340)], []

    def words(n):
        return [f"w{int(x)}" for x in rng.integers(0, 10**9, n)]

    for g in range(150):  # similarity of about 0.75 in the family and 0.85 in a pair
        shared = words(28)
        texts += [" ".join(template + shared + words(30)) for _ in range(2)]
    assert jaccard(texts[0], texts[1]) > 0.8 > 0.78 > jaccard(texts[0], texts[2])
    groups = {r.doc_id: r.component_id for r in simhash.similar_groups(docs_frame(spark, texts)).collect()}
    assert groups == {i: i - i % 2 for i in range(len(texts))}


def test_outsiders_of_a_large_group_do_not_meet_all_of_it(spark, monkeypatch):
    rng = np.random.default_rng(21)
    base = [f"t{i}" for i in range(150)]

    def changed(n, end):
        words = list(base)
        for at in rng.choice(np.arange(5, 145), n, replace=False):
            words[at] = f"x{int(rng.integers(0, 10**9))}"
        return " ".join([*words, end])

    # three changes are similar to the few texts without any only, others to most texts
    texts = [changed(n, f"e{i}") for i, n in enumerate([0] * 12 + [1] * 160 + [2] * 160 + [3] * 80 + [9] * 3)]
    made = {}

    def counted(name, f):
        def call(*args):
            made[name] = f(*args)
            return made[name]
        monkeypatch.setattr(simhash, name, call)

    counted("prefix_pairs", simhash.prefix_pairs)
    counted("centre_pairs", simhash.centre_pairs)

    groups = {r.doc_id: r.component_id for r in simhash.similar_groups(docs_frame(spark, texts)).collect()}
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(texts[i], texts[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert groups == dict(enumerate(root)) and len(set(root)) < 12
    assert made["centre_pairs"].distinct().count() <= simhash.CENTRES * len(texts)
    assert made["prefix_pairs"].distinct().count() <= simhash.CENTRES * len(texts)


def test_members_of_large_buckets_meet_few_leaders(spark, monkeypatch):
    rng = np.random.default_rng(31)
    base = [f"t{i}" for i in range(150)]

    def changed(n, end):
        words = list(base)
        for at in rng.choice(np.arange(5, 145), n, replace=False):
            words[at] = f"x{int(rng.integers(0, 10**9))}"
        return " ".join([*words, end])

    texts = [changed(n, f"e{i}") for i, n in enumerate([0] * 12 + [1] * 160 + [2] * 160 + [3] * 80)]
    compared, close = [], simhash.close_sketches

    def counted(pairs, *args):
        compared.append(pairs.where("a <> b").select(F.least("a", "b"), F.greatest("a", "b")).distinct().count())
        return close(pairs, *args)

    monkeypatch.setattr(simhash, "close_sketches", counted)
    groups = {r.doc_id: r.component_id for r in simhash.similar_groups(docs_frame(spark, texts)).collect()}
    near = [i for i, t in enumerate(texts) if any(i != j and jaccard(t, u) >= 0.8 for j, u in enumerate(texts))]
    assert len(near) == len(texts) and set(groups.values()) == {0}
    # the leaders' pairs come first: 4,128, or 10,805 with two leaders drawn anew in each bucket
    assert compared[0] <= 12 * len(texts)


def test_counts_of_shingles_do_not_depend_on_partitions(spark):
    sets = spark.createDataFrame([([7, -5, 100 + i],) for i in range(12)], "shingles array<int>")
    counts = [simhash.frequent_cells(sets.repartition(n)) for n in (1, 12)]
    assert counts[0][7] == 12 and counts[0].sum() == 24 and (counts[0] == counts[1]).all()
