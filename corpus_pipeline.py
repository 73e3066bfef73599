"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, then token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framewright.llm.bpe import bpe_encode
from framewright.llm.common import stored
from framewright.llm.decontaminate import drop_leaks
from framewright.llm.exact_dedup import drop_exact_copies
from framewright.llm.minhash import drop_near_duplicates
from framewright.llm.quality import drop_rejected, trusted_documents


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model, trained on the trusted ones, does not reject."""
    return drop_rejected(docs, trusted_documents(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the largest id."""
    return drop_exact_copies(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more, the one with the least id."""
    return drop_near_duplicates(docs, shingle_words=5, percent=80)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of the documents that are left."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe_encode(docs, path, ("n_tokens", "ids"), columns=["doc_id", "lang", "source"])


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", keep_one_of_copies),
    ("near dedup", keep_one_of_near_copies),
    ("benchmark decontamination", keep_unleaked),
    ("bpe encoding", encode),
]

#: The classifier's quantiles, signatures and token ids are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result stored before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
