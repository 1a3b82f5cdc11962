import hashlib
import re

from helpers import LONG, docs_frame, with_odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from ostinato.llm import private

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d),
            "phone": lambda: 10 <= len(d) <= 15}[kind]()


def brute(text):
    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if passes(k, m.group()))


def shown(spans):
    return ",".join(f"{private.KINDS[k]}:{a}:{b}" for a, k, b in spans)


TEXTS = ["mail bob.x@mail.example.com, now", "é😀 ip 10.20.30.40 and 300.1.1.1 and 0255.1.1.1.9", "+1 (988) 555-2485 4524132264652876 end", "4524-1322-6465-2876", None, "",
         "a@b.c_d@e.f@g.h", LONG + " zed@mail.example.org", "1 2 3 4 " * 3000, "+" + "1 " * 4000, "a" * 30000, "x@y", "write joe at mail dot com or call +49 (300) 555-1234",
         "4465758382889437 4465758382889437", "+1 (988) 555-2485 +1 (988) 555-2486"] + [f"mail u{i}@mail{i}.example.com ip 9.8.7.{i} tel +1 (212) 555-{1000 + i} " for i in range(20)]


def test_base_spans_against_brute_force(spark):
    docs = with_odd_rows(docs_frame(spark, TEXTS, {"spans": "x", "_base": 1, "n_email": 5}).drop("_base"), spark)
    rows = private.digest(private.find_private(docs)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        base = brute(None if r.doc_id is None else TEXTS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(shown(base).encode()).hexdigest(), r
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        spans = [s for s in r.spans.split(",") if s]
        assert set(shown(base).split(",")) - {""} <= set(spans)
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), private.KINDS.index(s.split(":")[0]), int(s.split(":")[2])))
    assert private.find_private(docs.limit(0)).count() == 0


def test_swallowed_spans_are_added_and_masked(spark):
    docs = docs_frame(spark, TEXTS)
    found = private.find_private(docs)
    texts = {r.doc_id: r.text for r in private.mask(found).collect()}
    assert texts[2] == "[PHONE] [CARD] end" and texts[13] == "[CARD] [CARD]"
    assert texts[0] == "mail [EMAIL], now" and texts[4] is None and texts[5] == ""
    assert texts[10] == TEXTS[10] and texts[11] == TEXTS[11]


def test_overlapping_spans_become_one(spark):
    df = spark.createDataFrame([("0123456789", [(1, 0, 4), (3, 1, 6), (6, 2, 7)])], "text string, spans array<struct<start:int,kind:int,end:int>>")
    assert private.mask(df).first().text == "0[EMAIL][CARD]789"


def test_any_text(spark):
    texts = []

    @settings(max_examples=600, deadline=None, database=None)
    @given(st.text(alphabet="0123456789.+-@() ab_%é,", max_size=40))
    def gather(t):
        texts.append(t)

    gather()
    rows = private.find_private(docs_frame(spark, texts)).collect()
    for r in rows:
        assert [tuple(s) for s in r.base_spans] == brute(r.text), r.text


def test_estimate_finds_the_reliable_labeler():
    counts = [(1, 1, 1, 0, 1, 500), (-1, -1, 1, 0, 0, 300), (1, 1, -1, 0, 1, 50), (-1, -1, -1, 0, 0, 40), (-1, 1, 1, 0, 0, 2)]
    likely = private.estimate(counts)
    assert likely[0] > 0.9 and likely[2] > 0.8 and likely[1] < 0.2 and likely[3] < 0.2
    shapes, w = private.train([(0, *r) for r in counts], likely)
    score = [shapes[0] + sum(a * v for a, v in zip(w, r[:-1])) for r in counts]
    assert score[0] > 0 > score[1] and score[2] > 0 > score[3]


def test_no_python_in_the_plan(spark):
    plan = private.with_candidates(docs_frame(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
