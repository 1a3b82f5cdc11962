"""Named queries of the training-data operators and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm import chat, decontaminate, licenses, pieces, private, quality, repair, sharding, simhash, token_counts, topk, vector_codes, warc
from ostinato.llm.common import table
from ostinato.session import fresh_path

import corpus_pipeline  # isort: skip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op9_decontaminate", decontaminate.ORACLE)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document inside benchmark windows of 13 words."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_contamination(docs, table(spark, folder, "benchmark")))


@query("op4_token_counts")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each document in the lower-casing word BPE."""
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


@query("op5_chat_format")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, formatted and read back."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    records = chat.records_of(rows.unionByName(control))
    turns = chat.canonical_turns(records, ["prompt", "completion", "instruction", "input", "output", "messages"])
    return chat.digest(chat.format_turns(turns))


@query("op7_shards")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in 40 shards by jump consistent hashing of doc_id."""
    return sharding.assign_shards(table(spark, folder, "documents").select("doc_id", "text"), 40)


@query("op10_top_k", topk.ORACLE)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Five highest integer inner products of every fiftieth vector against all others."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


@query("op6_quality")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of all documents, learned from labels that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.score(docs, table(spark, folder, "labels")).select("doc_id", "held_out", "score", "predicted")


@query("op1_simhash")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and the components of those within two bits."""
    return simhash.near_groups(table(spark, folder, "documents").select("doc_id", "text"))


@query("op2_private_data")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of personal data in all documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return private.digest(private.find_private(docs, keep_text=False))


@query("op3_sentencepiece")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """A sampled segmentation of each document, and whether decoding gives the text back."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    back = pieces.encode_pieces(docs, model, F.col("doc_id"), decoded="decoded")
    return back.select("doc_id", "n_pieces", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


@query("op8_licenses")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Licences of all documents, as files ``source/lang/doc_id``."""
    docs = table(spark, folder, "documents").select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return licenses.scan(docs, keep_text=False)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Documents after all stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, folder)


@query("op11_vector_codes", vector_codes.ORACLE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of all vectors in 16 parts of 64 entries, with errors a row and a label."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    return vector_codes.digest(*vector_codes.compress(vectors))


@query("op12_conversation_repair", repair.ORACLE)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, damaged and repaired with the fewest edits."""
    return repair.digest(table(spark, folder, "conversations"))


@query("op13_warc", warc.ORACLE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to archives with revisit records, and read back."""
    path = fresh_path(spark, "warc")
    warc.write(table(spark, folder, "pages"), path)
    return warc.resolved(warc.read(spark, path, with_payload=False))
