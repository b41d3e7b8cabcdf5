"""Positions in a series: split, guard and pairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketboard.config import MIN_SERIES_ROWS, SERIES, TRAIN_ROWS
from marketboard.functions.numbers import signed_round


def numbered(series: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Add pos = 1, 2, ... in date order within each series."""
    return series.withColumn(
        "pos", F.row_number().over(Window.partitionBy(*keys).orderBy("ds"))
    )


def long_enough(
    series: DataFrame, min_rows: int = MIN_SERIES_ROWS, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Rows of the series that have at least `min_rows` rows."""
    size = F.count("*").over(Window.partitionBy(*keys))
    return series.withColumn("_size", size).filter(F.col("_size") >= min_rows).drop("_size")


def train_part(
    series: DataFrame, train_rows: int = TRAIN_ROWS, keys: Sequence[str] = SERIES
) -> DataFrame:
    """The first rows of each series; the rank filter runs before the shuffle as well."""
    return numbered(series, keys).filter(F.col("pos") <= train_rows)


def test_part(
    series: DataFrame, train_rows: int = TRAIN_ROWS, keys: Sequence[str] = SERIES
) -> DataFrame:
    """The rows after the training rows, numbered from 1."""
    later = numbered(series, keys).filter(F.col("pos") > train_rows)
    return later.withColumn("pos", F.col("pos") - F.lit(train_rows))


def split_label(series: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    return numbered(series).withColumn(
        "part", F.when(F.col("pos") <= train_rows, "train").otherwise("test")
    )


def pair_by_position(
    actual: DataFrame, forecast: DataFrame, keys: Sequence[str] = SERIES
) -> DataFrame:
    """i-th actual row with i-th forecast row of each series; the longer side is cut."""
    predicted = forecast.select(*keys, "pos", F.col("ds").alias("forecast_ds"), "yhat")
    return actual.join(predicted, [*keys, "pos"])


def pair_by_date(
    actual: DataFrame, forecast: DataFrame, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Actual and forecast rows of the same series and date; dates without a partner drop out."""
    return actual.join(forecast.select(*keys, "ds", "yhat"), [*keys, "ds"])


def error_metrics(
    pairs: DataFrame, keys: Sequence[str] = SERIES, digits: int = 2
) -> DataFrame:
    """MAPE (percent) and MAE of each series that has pairs."""
    off = F.abs(F.col("y") - F.col("yhat"))
    return pairs.groupBy(*keys).agg(
        signed_round(F.avg(F.try_divide(off, F.abs("y"))) * F.lit(100.0), digits).alias("mape"),
        signed_round(F.avg(off), digits).alias("mae"),
    )
