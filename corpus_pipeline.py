"""A corpus from raw documents: each stage is written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketboard.llm import mixing, pieces, quality, secrets, simhash
from marketboard.llm.common import saved, shipped_to_stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a good verdict."""
    shipped_to_stage(spark)
    return quality.good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    shipped_to_stage(spark)
    return simhash.distinct_documents(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; n_chars follows the text."""
    shipped_to_stage(spark)
    cleaned = secrets.redacted(docs)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass that the mix makes over a document."""
    shipped_to_stage(spark)
    mixed = mixing.mixed_documents(docs)
    if "n_chars" not in docs.columns:
        return mixed
    return mixed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents and their token ids."""
    shipped_to_stage(spark)
    return pieces.encoded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("mixing_sources", mixing_sources),
    ("sentence_pieces", sentence_pieces),
]

#: SQL can express neither the fitted verdicts nor the fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
