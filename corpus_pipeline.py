"""A corpus on its way to training sequences, as stages over the table of documents.

Each stage takes what its predecessor kept, as written to Parquet and read again: (spark, docs, sf_dir) -> DataFrame.

1. language_id — documents without letters, and those whose language stays ambiguous, go.
2. ngram_jaccard_join — of each class of near duplicates one document stays, that with the smallest id.
3. pii — personal data is masked in the text; clean texts stay as they are.
4. packing — token pieces with their sequence and offset.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tastemill.llm import jaccard, language, packing, pii
from tastemill.session import work_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language. Null, empty and letterless texts are rejected, and so is a tie of two languages."""
    return language.accepted(docs, language.learn(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that with the smallest id, then the smallest hash of its text. Equal rows are one."""
    return jaccard.one_of_each_class(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("pii", mask_pii),
    ("packing", pack),
]

ORACLE_SQL = None  # classifiers, similarity classes, label decoding and packing plans are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is kept in the shared folder."""
    folder = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
