"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. Stages but the last return the columns of `documents`. All run in the same executors, so the stages with
workers set the session to send them small batches (`common.send_less`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import language, minhash, packing, quality, repeats
from quillon.llm.common import discard_all, materialize, send_less, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; texts without letters and those that fit no language well go."""
    send_less(spark)
    return language.keep_known(docs, least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 or more of its five-word shingles."""
    send_less(spark)
    return minhash.keep_one(docs, size=5, share=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that start earlier in the corpus; n_chars follows the text.

    Documents of which nothing is left stay, with an empty text.
    """
    send_less(spark)
    left = repeats.without_repeats(docs, carry=[c for c in docs.columns if c not in ("doc_id", "text")])
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: the pieces of all documents, with their places and ids."""
    import public_tokenizers

    send_less(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packed", packed),
]

#: Language, near-duplicate groups, passages and packing are beyond SQL; tests/llm holds them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. What a stage and its operator wrote is deleted once the next stage's table is there."""
    docs, before = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs, at = materialize(spark, stage(spark, docs, sf_dir), name)
        discard_all(spark, at, since=before)
    return STAGES[-1][1](spark, docs, sf_dir)
