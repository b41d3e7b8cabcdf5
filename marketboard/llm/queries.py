"""One query for each operator, over whole tables, with the parameters of production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketboard.llm import byte_pieces, licenses, mixing, neighbours, ngrams, pieces, quality, ranking, secrets, sharding, simhash, toxicity, vector_codes
from marketboard.llm.common import held_out, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assignments(table(spark, sf_dir, "documents"))


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.scored(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 1))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    scores = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(key, 3, 1))
    return scores.select("doc_id", held_out(key, 3, 1).alias("held_out"), "score", "predicted")


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, distance=2)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_byte_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pieces.round_trip(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_sentence_pieces,
        op3_lm_scoring,
        op4_quality_rules,
        op5_nearest_neighbours,
        op6_toxicity,
        op7_license_scans,
        op8_source_mixing,
        op9_secret_scans,
        op10_simhash,
        op11_vector_codes,
        op12_ranking,
        op13_byte_pieces,
    )
}

#: SQL for the queries that it can express.
ORACLE = {"op1_sharding": sharding.oracle(), "op11_vector_codes": vector_codes.oracle(), "op12_ranking": ranking.oracle()}
