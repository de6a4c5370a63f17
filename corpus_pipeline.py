"""Corpus pipeline: quality, toxicity, near-duplicates, PII, packing, in this order.

Each stage works on all its predecessor kept; its decisions take effect. Between stages the rows
are written as Parquet and read again, which cuts the lineage and survives lost executors. All
stages but the last return the columns of ``documents``. A stage's rows go when the next one's are
written, and the last ones, which the result may still read, when the driver ends. Batches for Python
workers are bounded by bytes in the session (``common.small_batches``), unless it has a bound of its own.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veldra.llm import near_copies, packing, pii, quality, toxicity
from veldra.llm.common import remove, remove_at_exit, shared_folder, small_batches, table
from veldra.llm.entries import WORDS, pii_key


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose text and site make low quality likely."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def civil_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of grade 1 or more."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: by the fingerprints of op9, and by similarity of the whole texts."""
    return near_copies.deduplicate(docs)


def private_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms."""
    return pii.mask(docs, pii_key(spark))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document's tokens in sequences."""
    return packing.pack(docs, public_tokenizers.path(WORDS))


STAGES = [
    ("quality", good_documents),
    ("toxicity", civil_documents),
    ("near_duplicates", distinct_documents),
    ("pii", private_documents),
    ("packing", packed_sequences),
]

#: Trained models, hashing and tokenizers are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's rows written in the shared folder and read by the next."""
    shared = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    remove_at_exit(spark, shared)
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{shared}/{k}-{name}")
            docs = spark.read.parquet(f"{shared}/{k}-{name}")
            if k:  # the next stage reads this one's rows only
                remove(spark, f"{shared}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
