"""Personal data by weak supervision, in column expressions only.

Base patterns give spans that always stay. Wider candidates (strict or obfuscated forms, also those that a longer base match
has swallowed) get votes of labelers: regex shape, gazetteer or check digits, boundaries, context words, base pattern.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is and how likely each pattern is
personal data. A logistic span classifier is trained on these likelihoods with votes and span shape as features, and becomes a column
expression; candidates it accepts are added unless they overlap a base span of their kind.

The counts of vote patterns cover all documents and are bounded: ``4 * 3**5 * 8`` rows at most reach the driver.

Null texts count as empty. Repeated rows are judged one by one. Spans are in code points, ends exclusive. Columns of the input stay; those named
like a result are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.llm.common import text_or_empty, with_fields
from ostinato.session import cut

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns, made possessive and anchored at the start of a run so that no text makes them backtrack or recurse.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
CANDIDATES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@|(?: at |\(at\)|\[at\]))[A-Za-z0-9-]++(?:(?:\.| dot |\(dot\)|\[dot\])[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?!\.?[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{13,19}+)(?![0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9+])\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}(?![0-9])",
}
QUICK = {"email": r"@|(?: at |\(at\)|\[at\])", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]|[0-9][ -][0-9]"}
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|me|app|dev|ai|eu|uk|de|fr|es|it|nl|be|ch|at|se|no|dk|fi|pl|pt|ru|jp|cn|in|br|mx|au|ca|us"
COUNTRY_CODES = "1|7|2[07]|3[0123469]|4[013456789]|5[12345678]|6[0123456]|8[1246]|9[0123458]|2[1234569][0-9]|3[578][0-9]|42[013]|5[09][0-9]|6[789][0-9]|8[058][0-9]|9[679][0-9]"
FOR_WORDS = {"email": "mail|contact|write|address|from|to", "ip": "ip|host|server|addr|from|login", "card": "card|visa|credit|pay|account",
             "phone": "phone|tel|call|mobile|fax|contact"}
AGAINST_WORDS = {"email": "example|package", "ip": "version|release|section|v", "card": "isbn|order|invoice|serial|sha|id", "phone": "isbn|order|invoice|id"}
LABELERS = ["regex", "check", "edges", "words", "base"]
SPAN = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
CONTEXT = 24


def located(df: DataFrame, name: str, text: Column, pattern: str, quick: str) -> DataFrame:
    """Adds the matches of a pattern with their places and nearby text: pieces between matches give the places."""
    found = F.when(text.rlike(quick), F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern).alias("p")))
    df = df.withColumn("_found", found)
    m, p = F.col("_found.m"), F.col("_found.p")
    pieces = F.transform(m, lambda x, i: F.struct(
        x.alias("match"), F.char_length(F.get(p, i)).alias("gap"), F.char_length(x).alias("n"),
        F.substring(F.get(p, i), -CONTEXT, CONTEXT).alias("before"), F.substring(F.get(p, i + 1), 1, CONTEXT).alias("after")))
    df = df.withColumn("_pieces", F.coalesce(pieces, F.array().cast("array<struct<match:string,gap:int,n:int,before:string,after:string>>")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        one = F.struct(s.alias("start"), (s + x["n"]).alias("end"), x["match"].alias("match"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct((s + x["n"]).alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    return df.withColumn(name, F.aggregate("_pieces", start, add)["spans"]).drop("_found", "_pieces")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def base_holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, "[.]"), lambda p: p.try_cast("double") <= 255)
    if kind == "card":
        return F.char_length(digits(m)).between(14, 19) & F.call_function("luhn_check", digits(m))
    if kind == "phone":
        return F.char_length(digits(m)).between(10, 15)
    return F.lit(True)


def vote(yes: Column, no: Column | None = None) -> Column:
    """1 where ``yes``, -1 where ``no`` (by default where not ``yes``), else 0."""
    return F.when(yes, F.lit(1)).when(~yes if no is None else no, F.lit(-1)).otherwise(F.lit(0))


def votes(kind: str, x: Column, base: Column) -> list[Column]:
    m = x["match"]
    shape = {
        "email": lambda: vote(m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$")),
        "ip": lambda: vote(m.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}$")),
        "card": lambda: vote(digits(m).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)")),
        "phone": lambda: vote(m.startswith("+") & F.char_length(digits(m)).between(10, 15)),
    }[kind]()
    check = {
        "email": lambda: vote(m.rlike(rf"(?i)\.(?:{DOMAINS})$"), F.lit(False)),
        "ip": lambda: vote(m.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.")),
        "card": lambda: vote(F.call_function("luhn_check", digits(m))),
        "phone": lambda: vote(m.rlike(rf"^\+(?:{COUNTRY_CODES})[^0-9]"), ~m.startswith("+")),
    }[kind]()
    edges = vote(~x["before"].rlike(r"[\p{L}\p{N}]$") & ~x["after"].rlike(r"^[\p{L}\p{N}]"))
    words = vote(x["before"].rlike(rf"(?i)\b(?:{FOR_WORDS[kind]})\b\W*$"), x["before"].rlike(rf"(?i)\b(?:{AGAINST_WORDS[kind]})\b\W*$"))
    same = vote(F.exists(base, lambda b: (b["start"] == x["start"]) & (b["end"] == x["end"])), F.lit(False))
    return [shape, check, edges, words, same]


def span_shape(kind: str, m: Column) -> Column:
    """A small number for the form of a span."""
    if kind == "email":
        return F.least(F.regexp_count(m, F.lit("[.]")), F.lit(5)) + F.when(m.contains("@"), 0).otherwise(2)
    if kind == "ip":
        return F.least(F.char_length(m) - 7, F.lit(7))
    if kind == "card":
        return F.when(m.rlike("[ -]"), F.lit(4)).otherwise(F.least(F.greatest(F.char_length(m) - 14, F.lit(0)), F.lit(3)))
    return F.least(F.greatest(F.char_length(digits(m)) - 8, F.lit(0)), F.lit(7))


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_base`` and ``_more``: base spans, and candidates with their votes and shapes, by kind."""
    t = text_or_empty(text)
    for kind in KINDS:
        docs = located(docs, f"_b_{kind}", t, BASE[kind], QUICK[kind])
        docs = docs.withColumn(f"_b_{kind}", base_only(kind))
        docs = located(docs, f"_c_{kind}", t, CANDIDATES[kind], QUICK[kind])
        docs = docs.withColumn(f"_c_{kind}", judged(kind))
    return docs.withColumns({"_base": F.struct(*[F.col(f"_b_{k}").alias(k) for k in KINDS]), "_more": F.struct(*[F.col(f"_c_{k}").alias(k) for k in KINDS])}) \
        .drop(*[f"_{x}_{k}" for k in KINDS for x in "bc"])


def base_only(kind: str) -> Column:
    held = F.filter(f"_b_{kind}", lambda x: base_holds(kind, x["match"]))
    return F.transform(held, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def judged(kind: str) -> Column:
    base = F.col(f"_b_{kind}")
    return F.transform(f"_c_{kind}", lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), span_shape(kind, x["match"]).cast("int").alias("shape"),
        *[v.alias(n) for n, v in zip(LABELERS, votes(kind, x, base))]))


def estimate(counts: list[tuple], rounds: int = 60) -> list[float]:
    """Likelihoods of (votes..., count) rows of one kind: expectation-maximisation with labelers independent given the class."""
    total = sum(r[-1] for r in counts)
    post = [1 / (1 + math.exp(-1.5 * sum(r[:-1]))) for r in counts]
    for _ in range(rounds):
        mass = sum(p * r[-1] for p, r in zip(post, counts))
        prior = (mass + 1) / (total + 2)
        tables = []
        for j in range(len(LABELERS)):
            yes, no = {v: 0.5 for v in (-1, 0, 1)}, {v: 0.5 for v in (-1, 0, 1)}
            for p, r in zip(post, counts):
                yes[r[j]] += p * r[-1]
                no[r[j]] += (1 - p) * r[-1]
            s, t = sum(yes.values()), sum(no.values())
            tables.append({v: math.log(yes[v] / s) - math.log(no[v] / t) for v in (-1, 0, 1)})
        logits = [math.log(prior / (1 - prior)) + sum(tables[j][r[j]] for j in range(len(LABELERS))) for r in counts]
        post = [1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) for z in logits]
    return post


def train(rows: list[tuple], likely: list[float], rounds: int = 400, ridge: float = 0.02) -> tuple[dict[int, float], list[float]]:
    """Logistic weights of shapes and votes for (shape, votes..., count) rows, by gradient steps on the likelihoods."""
    total = sum(r[-1] for r in rows) or 1
    shapes, w = {r[0]: 0.0 for r in rows}, [0.0] * len(LABELERS)
    for _ in range(rounds):
        g_shape, g = dict.fromkeys(shapes, 0.0), [0.0] * len(w)
        for r, y in zip(rows, likely):
            z = shapes[r[0]] + sum(a * v for a, v in zip(w, r[1:-1]))
            e = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * r[-1] / total
            g_shape[r[0]] += e
            g = [a + e * v for a, v in zip(g, r[1:-1])]
        shapes = {k: v - (g_shape[k] + ridge * v / total) * 2 for k, v in shapes.items()}
        w = [a - (b + ridge * a / total) * 0.8 for a, b in zip(w, g)]
    return shapes, w


def learn(candidates: DataFrame) -> dict[str, tuple[dict[int, float], list[float]]]:
    """Weights of the span classifier by kind, from all candidates of ``_more``."""
    model = {}
    parts = [candidates.select(F.lit(k).alias("kind"), F.explode(F.col("_more")[k]).alias("c")) for k in KINDS]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    columns = [F.col("c")[n].alias(n) for n in ["shape", *LABELERS]]
    counted = union.select("kind", *columns).groupBy("kind", "shape", *LABELERS).agg(F.count(F.lit(1)).alias("n"))
    rows = sorted(tuple(r) for r in counted.collect())
    for kind in KINDS:
        own = [r[1:] for r in rows if r[0] == kind]
        model[kind] = train(own, estimate([r[1:] for r in own])) if own else ({}, [0.0] * len(LABELERS))
    return model


def accepted(model: tuple[dict[int, float], list[float]], x: Column) -> Column:
    shapes, w = model
    z = F.lit(-1.0)
    for shape, value in sorted(shapes.items()):
        z = F.when(x["shape"] == shape, F.lit(value)).otherwise(z)
    for name, value in zip(LABELERS, w):
        z = z + F.lit(value) * x[name]
    return z >= 0


def added(kind: str, model: dict) -> Column:
    base = F.col("_base")[kind]
    return F.filter(F.col("_more")[kind], lambda x: accepted(model[kind], x) & (x["base"] != 1)
                    & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))


def kind_spans(spans: Column, number: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end")))


def find_private(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The documents with ``base_spans`` and ``spans``: start, kind (place in KINDS), end, in order.

    Candidates are stored once in the shared folder, with the input columns (without the text if ``keep_text`` is false).
    """
    found = with_candidates(docs, text)
    found = cut(found if keep_text else found.drop(text), "private")
    model = learn(found)
    base = F.sort_array(F.concat(*[kind_spans(F.col("_base")[k], i) for i, k in enumerate(KINDS)]))
    more = F.concat(*[kind_spans(added(k, model), i) for i, k in enumerate(KINDS)])
    out = found.withColumn("_base_spans", base).withColumn("_out", F.struct(
        F.col("_base_spans").alias("base_spans"), F.sort_array(F.concat("_base_spans", more)).alias("spans")))
    return with_fields(out.drop("_base", "_more", "_base_spans"), "_out", ["base_spans", "spans"])


def joined(spans: str) -> Column:
    """``kind:start:end`` of spans, with commas between."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Result rows of the query; counts are of base spans."""
    n = [F.size(F.filter("base_spans", kind_is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *n, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def kind_is(number: int):
    return lambda x: x["kind"] == number


def mask(found: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Each span in the text replaced by its kind in brackets; overlapping spans become one, named by the first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    t = F.col(text)

    def add(acc: Column, x: Column) -> Column:
        part = F.concat(F.substring(t, acc["at"] + 1, x["start"] - acc["at"]), F.get(names, x["kind"]))
        fresh = F.struct(x["end"].alias("at"), F.concat(acc["parts"], F.array(part)).alias("parts"))
        longer = F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["parts"].alias("parts"))
        return F.when((F.size(acc["parts"]) == 0) | (x["start"] >= acc["at"]), fresh).otherwise(longer)

    masked = F.aggregate(spans, start, add)
    found = found.withColumn("_m", F.when(F.size(spans) > 0, masked))
    whole = F.concat(F.array_join("_m.parts", ""), F.substring(t, F.col("_m.at") + 1, F.char_length(t)))
    return found.withColumn(text, F.when(F.size(spans) > 0, whole).otherwise(t)).drop("_m")
