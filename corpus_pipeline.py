"""A corpus pipeline of five stages: language ID, exact dedup, near dedup, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlex.llm import exact_dedup, language_id, near_dedup, packing, secret_scan
from lumenlex.llm.held_out import held_out
from lumenlex.llm.keep import kept_rows
from lumenlex.storage import materialize

WORDS = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts among them), or that resemble no language of the training rows.

    A row is judged by its own text alone, so rows that repeat a key or a text are judged alike. Without any labelled
    row to learn from, all documents with a letter stay. An empty table gives an empty one, here and in all stages.
    """
    model = language_id.fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    return language_id.keep_known(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null as empty, runs of white space as one blank), one row with the smallest doc_id stays; null is the smallest.

    Rows that repeat a doc_id with other texts are decided each for itself.
    """
    decisions = exact_dedup.exact_duplicates(docs)
    return kept_rows(docs, decisions, F.sha2(exact_dedup.normalised(F.col("text")), 256), "text_sha256")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles), the document with the smallest doc_id stays.

    Texts without words, null ones among them, resemble nothing and stay. A null doc_id goes if any document of its
    component has one. Rows that repeat a doc_id are told apart by their sets of shingles; of rows alike in both, one stays.
    """
    decisions = near_dedup.near_duplicates(docs, words=WORDS)
    return kept_rows(docs, decisions, near_dedup.set_ids(F.col("text"), WORDS), "set_id")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts; all documents stay, and each row is masked by its own text's spans, whatever its key.

    Null and empty texts pass unchanged; ``n_chars`` follows a masked text.
    """
    return secret_scan.mask(docs, secret_scan.scan(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 4096 tokens.

    A null or empty text is one piece of one token; rows that repeat a doc_id are packed each for itself.
    """
    pieces = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1, special_tokens=True)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=4096)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: SQL cannot express a string kernel, tokenization or bin completion; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", small_batches=True)
    return docs
