"""Text quality by a sparse rule ensemble.

Small trees are grown on text statistics of labelled documents; their paths are the rules: conjunctions of comparisons.
Lasso logistic regression gives most rules weight zero; the rest become one Spark column expression, so scoring is a plain
projection over all documents.

The trees are fitted on at most ``sample`` labelled documents, those with the smallest hash of their id. Labels, languages,
sources and ids are never inputs of a score. Held-out documents (``crc32(id) mod 5 = 0``) are never learned from.

Null texts count as empty; empty texts have statistics and a score like others. Without labels every score is 0.5, with one
class only the share of that class. Repeated label rows count once; unlabelled documents are scored like all others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.llm.common import keeps_columns, text_or_empty, with_fields

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, is it at most the value?, value)


def statistics(text: str = "text") -> dict[str, Column]:
    """Statistics of a whole text; shares are of its characters, words or lines."""
    t = text_or_empty(text)
    chars = F.greatest(F.char_length(t), F.lit(1))
    words, lines = F.split(F.trim(t), r"\s+"), F.split(t, "\n")
    n_words = F.size(words)
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    return {
        "log_chars": F.log1p(F.char_length(t)),
        "word_length": F.char_length(t) / n_words,
        "upper": count(r"\p{Lu}") / chars,
        "digits": count("[0-9]") / chars,
        "symbols": count(r"[^\p{L}\p{N}\s.,]") / chars,
        "symbol_runs": count(r"[^\p{L}\p{N}\s.,]{2,}+") / n_words,
        "lone_symbols": count(r"(?<!\S)[^\p{L}\p{N}\s](?!\S)") / n_words,
        "stops": count("[.]") / n_words,
        "upper_words": count(r"(?<!\p{L})\p{Lu}{2,}+(?!\p{Ll})") / n_words,
        "repeats": count(r"(?<!\S)(\S++) \1(?!\S)") / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_words": n_words / F.size(lines),
    }


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def grow(x: np.ndarray, y: np.ndarray, names: list[str], features: np.ndarray, depth: int, least: int, path: Rule = ()) -> list[Rule]:
    """Paths of one tree, inner ones included; splits lower the Gini impurity most among 16 quantiles of each feature."""
    found = [path] if path else []
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return found
    top = (1e-9, -1, 0.0)
    p = y.mean()
    for f in features:
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0.03, 0.97, 16))):
            left = x[:, f] <= cut
            n = int(left.sum())
            if least <= n <= len(y) - least:
                a, b = y[left].mean(), y[~left].mean()
                gain = p * (1 - p) - (n * a * (1 - a) + (len(y) - n) * b * (1 - b)) / len(y)
                if gain > top[0]:
                    top = (gain, int(f), float(cut))
    if top[1] < 0:
        return found
    left = x[:, top[1]] <= top[2]
    for side, at_most in ((left, True), (~left, False)):
        found += grow(x[side], y[side], names, features, depth - 1, least, (*path, (names[top[1]], at_most, top[2])))
    return found


def extract_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, seed: int = 7) -> list[Rule]:
    """Distinct rules of small trees, each grown on a part of the rows and of the statistics."""
    rng = np.random.default_rng(seed)
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        rows = rng.choice(len(y), min(len(y), 3000), replace=False)
        features = rng.choice(len(names), max(3, len(names) // 2), replace=False)
        rules.update(dict.fromkeys(tuple(sorted(r)) for r in grow(x[rows], y[rows], names, features, depth, max(5, len(rows) // 200))))
    return list(rules)


def holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for name, at_most, value in rule:
        v = x[:, names.index(name)]
        out &= v <= value if at_most else v > value
    return out


def lasso_logistic(m: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient; the intercept is not penalised. The matrix (single precision) is scaled in place."""
    n = len(y)
    center = m.mean(axis=0, dtype=np.float64)
    scale = np.maximum(np.sqrt(np.maximum(np.einsum("ij,ij->j", m, m) / n - center ** 2, 0)), 0.02)
    z = m
    z -= center.astype(m.dtype)
    z /= scale.astype(m.dtype)
    v = np.random.default_rng(0).normal(size=z.shape[1]).astype(m.dtype)
    for _ in range(20):  # largest curvature
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + m.dtype.type(1e-12)
    rate = 1 / (0.25 * max(float(v @ (z.T @ (z @ v))) / n, 1.0) * 1.1 + 0.25)
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w, w0, t = np.zeros(z.shape[1]), float(np.log(p / (1 - p))), 1.0
    u, u0 = w.copy(), w0
    for _ in range(steps):
        # vectors take the matrix's precision, or each product would make a second matrix
        error = 1 / (1 + np.exp(-np.clip((z @ u.astype(z.dtype)).astype(np.float64) + u0, -40, 40))) - y
        g = u - rate * (z.T @ error.astype(z.dtype)) / n
        new, new0 = np.sign(g) * np.maximum(np.abs(g) - rate * penalty, 0), u0 - rate * float(error.mean())
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        u, u0 = new + (t - 1) / t2 * (new - w), new0 + (t - 1) / t2 * (new0 - w0)
        w, w0, t = new, new0, t2
    w = w / scale
    return w0 - float(center @ w), w


def fit(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = 0.003) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept and weighted rules."""
    if len(y) == 0:
        return 0.0, []
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    if y.min() == y.max():
        return float(np.log(p / (1 - p))), []
    rules = extract_rules(x, y, names)
    if not rules:
        return float(np.log(p / (1 - p))), []
    m = np.empty((len(y), len(rules)), dtype=np.float32)
    for k, r in enumerate(rules):
        m[:, k] = holds(r, x, names)
    start, w = lasso_logistic(m, y, penalty)
    return start, [(float(a), r) for a, r in zip(w, rules) if abs(a) > 1e-6]


def compiled(start: float, rules: list[tuple[float, Rule]], column) -> Column:
    """The score as a column; ``column(name)`` gives a statistic."""
    total = F.lit(start)
    for weight, rule in rules:
        test = None
        for name, at_most, value in rule:
            one = column(name) <= value if at_most else column(name) > value
            test = one if test is None else test & one
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = 12_000) -> tuple[float, list[tuple[float, Rule]]]:
    """Fit on at most ``sample`` labelled documents, chosen by the hash of their id over all labels."""
    named = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_y")).where(f"_id IS NOT NULL AND _y IS NOT NULL")
    chosen = named.where(~held_out("_id")).distinct().orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    stats = statistics(text)
    # only what is needed meets the labels, whatever else the documents' columns are called
    named_docs = docs.select(F.col(doc_id).alias("_d"), F.struct(*[c.cast("double").alias(n) for n, c in stats.items()]).alias("_s"))
    rows = named_docs.join(F.broadcast(chosen), F.col("_d") == F.col("_id")).select("_id", "_y", "_s.*")
    # documents that share an id could exceed the sample: keep one of each
    rows = rows.groupBy("_id", "_y").agg(*[F.min(n).alias(n) for n in stats]).orderBy("_id", "_y").drop("_id").toArrow()
    columns = [rows.column(n).to_numpy().astype(np.float64) for n in ["_y", *stats]]
    return fit(np.column_stack(columns[1:]), columns[0], list(stats))


@keeps_columns
def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, **kw) -> DataFrame:
    """The documents with held_out, score (0 to 1, higher: better) and predicted (1 if ``score >= threshold``)."""
    start, rules = learn(docs, labels, doc_id, text, **kw)
    used = sorted({n for _, r in rules for n, _, _ in r})
    stats = statistics(text)
    fields = F.struct(*[stats[n].cast("double").alias(n) for n in used]) if used else F.struct(F.lit(0.0).alias("none"))
    # generated, not projected: a filter on the score would else be moved below the statistics, with each of them copied into every rule that names it
    out = docs.withColumn("_stats", F.explode(F.array(fields)))
    value = compiled(start, rules, lambda n: F.col("_stats")[n])
    out = out.withColumn("_out", F.struct(held_out(doc_id).alias("held_out"), value.alias("score"))).drop("_stats")
    return with_fields(out, "_out", ["held_out", "score"]).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
