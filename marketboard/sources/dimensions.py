"""Crop and market dimensions from nested JSON documents."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSION_SCHEMA = """
    mandis map<string, struct<state: string, lat: double, lon: double, apmc_code: string>>,
    crops map<string, struct<aliases: array<string>, harvest_months: array<int>,
                             shelf_life_days: int, rain_sensitivity: string>>
"""


class Dimensions(NamedTuple):
    mandis: DataFrame
    crops: DataFrame
    aliases: DataFrame


def read_dimensions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.option("multiLine", multi_line).schema(DIMENSION_SCHEMA).json(path)


def dimensions(documents: DataFrame) -> Dimensions:
    """Split the documents into markets, crops and (alias, name) rows."""
    mandis = documents.select(F.explode("mandis").alias("mandi", "_v")).select("mandi", "_v.*")
    crops = documents.select(F.explode("crops").alias("crop", "_v"))
    aliases = crops.select(
        F.explode("_v.aliases").alias("alias"), F.col("crop").alias("name")
    )
    return Dimensions(mandis, crops.select("crop", "_v.*"), aliases)
