from helpers import LONG

from ostinato.llm import licenses

FILES = [
    (0, "LICENSE", "Released under the MIT License."), (1, "src/a.py", "code\nLicensed under the Apache License, Version 2.0.\nmore"),
    (2, "src/b.py", "no header"), (3, "src/gpl/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
    (4, "src/gpl/deep/er/c.py", "nothing"), (5, "src/gplx/d.py", ""), (6, None, None), (7, "/src//e.py", "mit dem Wagen"),
    (8, "docs/NOTICE", "Licensed under CC BY-NC 4.0."), (9, "docs/x", "y"), (10, "big", LONG + "\n# SPDX-License-Identifier: MPL-2.0\n" + LONG),
    (11, "LICENSE", "Released under the MIT License."), (12, "src/f.py", "# Licensed under the Apache License,\n# Version 2.0.\n\ncode"),
]


def scanned(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    from pyspark.sql import functions as F

    return {r.doc_id: (r.license, r.basis, r.license_folder) for r in licenses.scan(df.withColumn("license", F.lit(1)).withColumn("basis", F.lit("x")), **kw).collect()}


def test_headers_files_and_inheritance(spark):
    got = scanned(spark, FILES)
    assert got == {
        0: ("MIT", "file", ""), 1: ("Apache-2.0", "header", None), 2: ("MIT", "inherited", ""), 3: ("GPL-3.0", "file", "src/gpl"),
        4: ("GPL-3.0", "inherited", "src/gpl"), 5: ("MIT", "inherited", ""), 6: ("MIT", "inherited", ""), 7: ("MIT", "inherited", ""),
        8: ("CC-BY-NC-4.0", "file", "docs"), 9: ("CC-BY-NC-4.0", "inherited", "docs"), 10: ("MPL-2.0", "header", None),
        11: ("MIT", "file", ""), 12: ("Apache-2.0", "header", None)}


def test_without_licences_and_empty(spark):
    assert scanned(spark, [(1, "a/b", "x"), (1, "a/b", "x"), (2, None, None)]) == {1: (None, None, None), 2: (None, None, None)}
    df = spark.createDataFrame([], "doc_id long, path string, text string")
    assert licenses.scan(df).count() == 0


def test_cosines_against_plain_arithmetic(spark):
    import math
    import re

    df = spark.createDataFrame([(t,) for t in ["Released under the MIT License.", "licensed under cc by sa 4.0 words", "Apache License", "zzz"]], "text string")
    w = licenses.weigh(df)
    out = df.withColumn("b", licenses.cosines(licenses.tokens_of(df.text), w)).collect()
    for r in out:
        tokens = set(re.findall(licenses.TOKEN, r.text.lower()))
        weight = {t: w.idf.get(t, w.most) for t in tokens}
        norm = math.sqrt(sum(x * x for x in weight.values()))
        best = min((-round(sum(w.idf[t] ** 2 for t in tokens & set(ts)) / norm / w.norm(ts), 6), n) for n, ts in w.rows)
        assert abs(r.b.score + best[0]) < 2e-6 and (best[0] == 0 or r.b.license == best[1])


def test_anchors_lose_nothing():
    counts = {t: 3 * i for i, t in enumerate(licenses.Weights(0, {}, licenses.TEMPLATES).vocabulary)}
    w = licenses.Weights(1000, counts, licenses.TEMPLATES)
    anchors = set(w.anchors(0.6))
    for _, tokens in w.rows:
        assert w.norm([t for t in tokens if t not in anchors]) < 0.6 * w.norm(tokens)


def test_same_licence_at_any_number_of_files(spark):
    lines = ["Licensed under the Apache License, Version 2.0. foo bar baz", "Copyright 2020 Jane Doe. Licensed under the Apache License, Version 2.0."]
    df = spark.createDataFrame([(t,) for t in lines], "text string")
    share = {"license": 100, "licensed": 200, "under": 20, "the": 2, "version": 50, "0": 10, "2": 8, "apache": 500}
    found = []
    for files in (10**4, 10**6, 10**8):
        w = licenses.Weights(files, {t: files // n for t, n in share.items()}, licenses.TEMPLATES)
        found.append([(r.text, r._header and (r._header.license, round(r._header.score, 2))) for r in licenses.headers(df, w).orderBy("text").collect()])
    assert found[0] == found[1] == found[2] and all(h and h[0] == "Apache-2.0" for _, h in found[0])


def test_common_words_weigh_little(spark):
    rows = [("Alpha beta gamma delta",)] * 30 + [("Alpha beta",)] * 30 + [("x",)] * 4
    df = spark.createDataFrame(rows, "text string")
    w = licenses.weigh(df)
    parts = spark.createDataFrame([(["mit", "license", "alpha", "beta"],), (["mit", "license", "qq", "rr"],)], "part array<string>")
    got = {r.part[2]: r.best.score for r in licenses.judged(parts, df, w, "text", 0.0).collect()}
    assert got["alpha"] > got["qq"] + 0.1
