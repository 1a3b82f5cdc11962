"""Token counts by a two-tier look-up of pre-token lengths, without a shuffle of pre-tokens.

Tier one is a compact table of the lengths of the corpus's frequent pre-tokens, sent to all workers. Its words come from
one pass over all texts, in which every task returns at most ``per_task`` of its commonest words; ``frequent`` of them are
kept, so the table is bounded. Tier two is a cache in each worker, filled by the tokenizer library for words it meets.
Both tiers change the speed only: each count is the one of the library.

Texts of Latin letters and common punctuation are cut to pre-tokens here; other texts, and those with special-token
strings, go to the library, in parts that end at white space. Null texts count as empty; documents are counted one by one, copies too.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from array import array
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.common import text_or_empty, with_fields, worker_cached

LATIN = [chr(c) for c in range(0x180) if c != 0x130]
SPACES = "".join(c for c in LATIN if c.isspace() and c not in "\x1c\x1d\x1e\x1f")
LETTERS = "".join(c for c in LATIN if unicodedata.category(c)[0] == "L")
NUMBERS = "".join(c for c in LATIN if unicodedata.category(c)[0] == "N")
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
UNUSUAL = re.compile("[^\x00-įı-ſ‐-―‘-‟•…]|<\\|")
PART = 1 << 20
LONG_WORD = 64


def parts(text: str, size: int = PART):
    """Parts of about ``size`` characters; each but the last ends before a blank, tab or line feed."""
    at, space = 0, re.compile(r"[ \t\n]")
    while len(text) - at > size:
        m = space.search(text, at + size)
        if not m:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


class Lengths(dict):
    """Token counts of pre-tokens; misses are encoded and kept up to a bound."""

    def __init__(self, path: str, frequent: tuple[str, array] | None, bound: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.first = dict(zip(frequent[0].split(" "), frequent[1])) if frequent and frequent[0] else {}
        self.bound = bound
        super().__init__(self.first)

    def __missing__(self, word: str) -> int:
        n = len(self.library.encode(word, add_special_tokens=False).ids)
        if len(word) <= LONG_WORD:
            if len(self) >= self.bound:
                self.clear()
                self.update(self.first)
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if UNUSUAL.search(text):
            return sum(len(self.library.encode(p, add_special_tokens=False).ids) for p in parts(text))
        return sum(sum(map(self.__getitem__, PRE_TOKEN.findall(p.lower()))) for p in parts(text))


def frequent_words(docs: DataFrame, text: str, per_task: int, keep: int) -> list[str]:
    """The commonest pre-tokens: every task sums its own in a bounded table, and at most ``per_task`` of each task are added up."""
    def summaries(batches):
        seen: Counter = Counter()
        for batch in batches:
            for t in batch["t"]:
                if not UNUSUAL.search(t):
                    for p in parts(t):
                        seen.update(PRE_TOKEN.findall(p.lower()))
                if len(seen) > 100 * per_task:
                    seen = Counter(dict(seen.most_common(10 * per_task)))
        top = [(w, n) for w, n in seen.most_common(per_task) if len(w) <= LONG_WORD]
        yield pd.DataFrame({"w": [w for w, _ in top], "n": [n for _, n in top]}).astype({"w": object, "n": "int64"})

    sums = docs.select(text_or_empty(text).alias("t")).mapInPandas(summaries, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return [r[0] for r in sums.orderBy(F.desc("n"), "w").limit(keep).collect()]


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 2048, frequent: int = 16384, per_task: int = 4096,
                 bound: int = 400_000) -> DataFrame:
    """The documents with n_bytes (UTF-8), n_tokens and over_limit (``n_tokens > limit``).

    ``tokenizer`` is the path of a tokenizer file that all workers can read. ``bound`` limits the words a worker keeps.
    """
    spark = docs.sparkSession
    words = frequent_words(docs, text, per_task, frequent)
    lengths = Lengths(tokenizer, None, len(words) + 1)
    sent = spark.sparkContext.broadcast((" ".join(words), array("I", [lengths[w] for w in words])))
    token = uuid.uuid4().hex

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        table = worker_cached("token_counts", token, lambda: Lengths(tokenizer, sent.value, bound))
        return texts.map(table.count).astype("int64")

    t = text_or_empty(text)
    out = docs.withColumn("_n", F.struct(F.octet_length(t).cast("long").alias("n_bytes"), counted(t).alias("n_tokens")))
    out = with_fields(out, "_n", ["n_bytes", "n_tokens"])
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
