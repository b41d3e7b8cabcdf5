"""A searchable table of passages: their vectors, bigint ids, and the fitted encoder that made them.

Each row names the folder of its encoder, so questions are always encoded as the passages were, also while a table is
being replaced by one with another encoder.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketboard.config import OVER_FETCH, TOP_K
from marketboard.operators.retrieval import retrieve
from marketboard.operators.vectors import VECTOR_SIZE, encode, fit_encoder
from marketboard.sources.storage import shared_dir
from marketboard.sources.tables import read_table, write_table

FIELDS = ["chunk_id", "crop", "source_doc", "page", "text"]


@dataclass(frozen=True)
class Store:
    """An opened table: vectors has id, the fields of the passages, embedding and encoder."""

    vectors: DataFrame
    encoder: PipelineModel
    encoder_path: str


def _rows(chunks: DataFrame, encoder: PipelineModel, path: str, number: str) -> DataFrame:
    kept = chunks.select(F.col(number).cast("bigint").alias("id"), *FIELDS)
    return encode(kept, encoder).withColumn("encoder", F.lit(path))


def save_store(
    chunks: DataFrame, target: str, encoders: str | None = None, number: str = "number", size: int = VECTOR_SIZE
) -> int:
    """Fit an encoder to the texts of chunks, keep it in a new folder under `encoders`, write all vectors to a table.

    chunks: a stored table with a unique bigint `number` and the FIELDS. target: a path or a table name; encoders: a folder
    that all executors reach (by default one in the shared folder). Gives the number of rows. NULL texts
    have the zero vector.
    """
    encoder = fit_encoder(chunks, size=size)
    path = f"{encoders or shared_dir(chunks.sparkSession) + '/encoders'}/{uuid.uuid4().hex}"
    encoder.write().save(path)
    write_table(_rows(chunks, encoder, path, number), target)
    return read_table(chunks.sparkSession, target).count()


def open_store(spark: SparkSession, target: str) -> Store:
    """The table at a path or by its name, with the encoder that its rows name."""
    vectors = read_table(spark, target)
    first = vectors.select("encoder").first()
    if first is None:
        raise ValueError(f"no passages in {target}")
    return Store(vectors, PipelineModel.load(first["encoder"]), first["encoder"])


def add_to_store(chunks: DataFrame, target: str, number: str = "number") -> None:
    """Append passages with ids of their own, encoded as those that are there."""
    store = open_store(chunks.sparkSession, target)
    write_table(_rows(chunks, store.encoder, store.encoder_path, number), target, mode="append")


def search(
    store: Store, questions: DataFrame, top_k: int = TOP_K, over_fetch: int = OVER_FETCH, prefilter: bool = False, **limits
) -> DataFrame:
    """Best passages for every question: query_id, rank, score, id and the fields.

    questions: query_id, text, crop (NULL: any). See retrieve for the two ways in which the crop counts. A question that
    shares no term with any passage scores 0 everywhere and gets the first ones by id.
    """
    asked = encode(questions.select("query_id", "text", "crop"), store.encoder)
    found = retrieve(asked, store.vectors.drop("encoder"), top_k, over_fetch, prefilter, **limits)
    return found.select("query_id", "rank", "score", "id", *FIELDS)
