import itertools
import random

from pyspark.sql import functions as F

from ostinato.operators import corrections as corr
from ostinato.operators import tag_metrics as tm
from ostinato.operators import tags as tg
from ostinato.plans.tagging import BudgetExceeded, run_tagging


def brute(tags, works):
    groups = {}
    group_of = dict(works)
    sets = {}
    for w, t in tags:
        sets.setdefault(w, set()).add(t)
    for w, s in sets.items():
        if group_of.get(w):
            groups.setdefault(group_of[w], []).append(s)
    return {g: (len(ss), sum(len(a & b) / len(a | b) for a, b in itertools.combinations(ss, 2))) for g, ss in groups.items() if len(ss) > 1}


def test_group_similarity_equals_pairs(spark):
    rng = random.Random(5)
    works = [(i, rng.choice(["a", "b", None, "", "c"]) if i else "only") for i in range(60)]
    tags = [(w, f"t{rng.randrange(9)}") for w, _g in works for _ in range(rng.randrange(0, 7))]
    t = spark.createDataFrame(tags, "work_id int, tag string")
    w = spark.createDataFrame(works, "work_id int, g string")
    want = brute(tags, works)
    got = {r.grp: (r.works_count, r.sum_similarity) for r in tm.group_similarity(t, w, "g").collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g][0] == want[g][0] and abs(got[g][1] - want[g][1]) < 1e-9


def test_long_tag_sets(spark):
    """Sets of 13 to 30 tags in many blocks."""
    rng = random.Random(6)
    works = [(i, "g") for i in range(40)]
    tags = [(w, f"t{x}") for w, _g in works for x in rng.sample(range(40), rng.randrange(13, 31))]
    t, w = spark.createDataFrame(tags, "work_id int, tag string"), spark.createDataFrame(works, "work_id int, g string")
    (count, total), = brute(tags, works).values()
    sets = tm._tag_sets(t, w, ["g"])
    for rows in (5, 2000):
        assert abs(tm._set_sums(sets, rows).first().s - total) < 1e-9
    assert tm.group_similarity(t, w, "g").first().works_count == count


def test_hot_tag_set(spark):
    """A third of the works share one tag set: nothing is paired."""
    w = spark.range(30000).select(F.col("id").alias("work_id"), F.lit("g").alias("g"))
    t = w.select("work_id", F.explode(F.when(F.col("work_id") % 3 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.concat(F.lit("u"), F.col("work_id"))))).alias("tag"))
    r = tm.group_similarity(t, w, "g").first()
    assert r.works_count == 30000 and r.pairs == 30000 * 29999 // 2 and r.sum_similarity == 10000 * 9999 / 2


def test_metrics(spark):
    tags = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (9, "z")], "work_id int, tag string")
    works = spark.createDataFrame([(1,), (2,), (3,)], "work_id int")
    c = tm.coverage(tags, works).first()
    assert (c.tagged_works, c.coverage_pct, c.avg_tags_per_work) == (3, 100.0, 1.33)
    d = tm.diversity(tags).first()
    assert (d.unique_tags, d.entropy, d.normalized_entropy, d.top_5_concentration_pct) == (3, 1.5, 0.946, 100.0)
    empty = tm.diversity(tags.limit(0)).first()
    assert (empty.unique_tags, empty.entropy, empty.normalized_entropy) == (0, 0.0, 0.0)


def test_responses(spark):
    rows = ['{"tags": ["dramatic","invalid-tag","famous"]}', '```json\n{"tags": ["dramatic"]}\n```', '```{"tags": []}```', "no json", '{"other": 1}']
    df = spark.createDataFrame([(r,) for r in rows], "response string")
    got = [(r.tags, r.error is None) for r in tg.parse_responses(df).collect()]
    assert got == [(["dramatic", "famous"], True), (["dramatic"], True), ([], True), ([], False), ([], True)]


def test_category(spark):
    df = spark.createDataFrame([("virtuosic",), ("romantic",), ("organ",), ("nope",)], "t string")
    assert [r[0] for r in df.select(tg.tag_category(F.col("t"))).collect()] == ["character", "mood", "instrumentation", "unknown"]


def test_costs(spark):
    e = tg.cost_estimate(spark.range(100)).first()
    assert (e.estimated_tokens, e.estimated_cost_usd, e.estimated_time_minutes, e.within_budget) == (70000, 0.45, 1.7, True)
    r = spark.createDataFrame([(i, ["a"] if i > 1 else [], None if i > 1 else "x", 10, 5) for i in range(10)], "work_id int, tags array<string>, error string, input_tokens int, output_tokens int")
    assert tg.run_stats(r).first().request_success_rate == 0.8


def works_frame(spark):
    return spark.createDataFrame([("w1", None, "Scherzo", None, "E minor", None), ("w2", None, "Plain", None, None, None), ("w3", None, "Waltz in C", None, "C major", None)],
                                 "work_id string, composer_id string, title string, work_type string, key string, catalog_number string")


def test_tagging_job(spark):
    comp = spark.createDataFrame([], "composer_id string, name string, period string, birth_year int, death_year int")
    old = spark.createDataFrame([("w3", "cheerful", "musicbrainz", 1.0)], "work_id string, tag string, source string, confidence double")
    run = run_tagging(works_frame(spark), comp, old)
    assert {(r.work_id, r.tag) for r in run.new_tags.collect()} == {("w1", "playful"), ("w1", "energetic"), ("w1", "contemplative"), ("w1", "introspective")}
    assert [r.work_id for r in run.processed.collect()] == ["w1"]  # w2 got no tags and stays pending
    again = run_tagging(works_frame(spark), comp, old, processed=run.processed)
    assert again.estimate["total_works"] == 1
    try:
        run_tagging(works_frame(spark), comp, old, max_cost_usd=0.0001)
        raise AssertionError("no budget gate")
    except BudgetExceeded:
        pass

    def failing(texts):
        if any("Scherzo" in x for x in texts):
            raise RuntimeError("down")
        return [["dark"] for _ in texts]

    r = {x.work_id: (x.tags, x.error) for x in tg.custom_tags(tg.tagging_context(works_frame(spark), comp), failing).collect()}
    assert r["w1"] == ([], "down") and r["w2"] == (["dark"], None)


def test_pending_cap(spark):
    w = spark.range(120).withColumnRenamed("id", "work_id")
    assert [tg.pending_works(w, None, n).count() for n in (None, 7, 0)] == [120, 7, 50]


def test_review_merge(spark):
    new = spark.createDataFrame([("a", "x", "auto-tagger", 1.0), ("b", "x", "auto-tagger", 1.0), ("b", "y", "auto-tagger", 1.0), ("c", "x", "auto-tagger", 1.0)],
                                "work_id string, tag string, source string, confidence double")
    dec = spark.createDataFrame([("a", "rejected", []), ("b", "corrected", ["y", "z"]), ("c", "approved", [])], "work_id string, decision string, new_tags array<string>")
    assert sorted(tuple(r)[:3] for r in tg.merge_review(new, dec).collect()) == [("b", "y", "auto-tagger"), ("b", "z", "human-review"), ("c", "x", "auto-tagger")]
    o = tg.review_outcome(dec).first()
    assert (o.approval_rate, o.auto_approve) == (2 / 3, False)


def test_corrections(spark):
    rows = [("Sonata", ["a"], ["b"])] * 3 + [("Mass", ["a"], [])] * 2 + [(None, [], ["c"])]
    c = spark.createDataFrame([(str(i), w, r, a, f"2024-01-0{i + 1}") for i, (w, r, a) in enumerate(rows)],
                              "work_id string, work_type string, removed array<string>, added array<string>, timestamp string")
    p = {(r.type, r.tag, r.frequency) for r in corr.patterns(c).collect()}
    assert p == {("work_type_missing_tag", "b", 3), ("frequently_incorrect_tag", "a", 5)}
    assert {r.slot for r in corr.suggestions(c).collect()} == {1, 3}
    none = corr.suggestions(c.limit(0)).collect()
    assert [r.suggestion for r in none] == ["Not enough corrections yet to generate specific suggestions"]
    t = corr.totals(c).first()
    assert (t.total_corrections, t.total_tags_removed, t.avg_tags_added, t.last_correction) == (6, 5, 0.67, "2024-01-06")
