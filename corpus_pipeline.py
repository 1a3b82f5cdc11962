"""The corpus pipeline: quality, near-duplicates, benchmark contamination, personal data, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm import decontaminate, pieces, private, quality, simhash
from ostinato.llm.common import remove_path, stored, table

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.score(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*DOCUMENT)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return simhash.drop_near_duplicates(docs).select(*DOCUMENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark contamination."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*DOCUMENT)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    masked = private.mask(private.find_private(docs))
    return masked.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(*DOCUMENT)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a sampled segmentation in pieces."""
    import public_tokenizers

    encoded = pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), F.col("doc_id"))
    return encoded.select(*DOCUMENT, "ids", "n_pieces")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_first_copies),
    ("decontamination", drop_contaminated),
    ("private_data", mask_private),
    ("pieces", encode_pieces),
]

#: Trees, groups and samplings have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents. The copy of a stage is deleted when the next one is written; that of the last stays."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, done = stored(stage(spark, docs, sf_dir), name)
        if path:
            remove_path(spark, path)
        path = done
    return docs
