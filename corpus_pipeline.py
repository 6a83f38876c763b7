"""A corpus pipeline of the operators for training data: each stage reads the Parquet that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import encoding, mixing, neardup, quality, secrets
from folioforge.llm.common import documents, stored
from folioforge.llm.queries import tokenizer


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return neardup.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passes over the documents in training order, by the sources' target weights."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each pass."""
    return encoding.encode(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", good_documents), ("near_duplicates", one_of_each), ("secrets", without_secrets), ("mixing", mixture), ("bpe", encoded)]

#: The classifier is learnt, and positions in a text are not SQL's: held against a brute-force version in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, but the last."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
