"""Columns of the input named like columns that operators use inside."""

import pytest
from helpers import docs_frame
from pyspark.sql import functions as F

from ostinato.llm import licenses, pieces, quality, simhash

NAMES = ["_id", "_y", "_d", "_s", "_stats", "_out", "_loser", "_row", "_parts", "_all", "_header", "_whole", "_clean", "_folder", "_p", "_key", "_text", "others", "Others_"]
TEXTS = ["Good text about things. It goes on.", "buy buy buy buy", "Licensed under the MIT License.", None, "another sentence here"]


def marked(spark):
    return docs_frame(spark, TEXTS).select("*", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), *[F.lit(f"own {n}").alias(n) for n in NAMES])


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(5)], "doc_id long, quality int, toxic int").withColumn("_d", F.lit(1))


CALLS = {
    "quality": lambda spark, d: quality.score(d, labels(spark)),
    "simhash": lambda spark, d: simhash.drop_near_duplicates(d),
    "licenses": lambda spark, d: licenses.scan(d),
    "pieces": lambda spark, d: pieces.encode_pieces(d, pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"), F.col("doc_id")),
}


@pytest.mark.parametrize("name", CALLS)
def test_own_columns_stay(spark, name):
    rows = CALLS[name](spark, marked(spark)).collect()
    assert len(rows) == len(TEXTS) and {r.doc_id: r.text for r in rows} == dict(enumerate(TEXTS))
    assert all(r[n] == f"own {n}" for r in rows for n in NAMES)
