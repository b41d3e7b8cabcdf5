"""Rolling price features and trend labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketboard.config import (
    FALL_THRESHOLD_PCT,
    LONG_FRAME_ROWS,
    RISE_THRESHOLD_PCT,
    SERIES,
    SHORT_FRAME_ROWS,
)
from marketboard.functions.numbers import exact_mean, pct_off, signed_round


def trailing_mean(rows: int, price: str = "modal_price") -> Column:
    """Mean of the last `rows` rows of a series, the current one included (rows, not days)."""
    frame = Window.partitionBy(*SERIES).orderBy("date").rowsBetween(1 - rows, 0)
    return exact_mean(F.col(price), over=frame)


def trend_label(
    pct: Column, fall: float = FALL_THRESHOLD_PCT, rise: float = RISE_THRESHOLD_PCT
) -> Column:
    return F.when(pct <= fall, "FALLING").when(pct >= rise, "RISING").otherwise("STABLE")


def gold(
    silver: DataFrame,
    short: int = SHORT_FRAME_ROWS,
    long: int = LONG_FRAME_ROWS,
    fall: float = FALL_THRESHOLD_PCT,
    rise: float = RISE_THRESHOLD_PCT,
) -> DataFrame:
    """Add avg_7d, avg_30d, pct_change_7d and trend.

    Both frames share one exchange and one sort. The input holds one row per date and series, so
    a window partition is at most as long as the calendar, whatever the volume of raw rows.
    """
    means = silver.withColumns(
        {"avg_7d": trailing_mean(short), "avg_30d": trailing_mean(long)}
    )
    pct = signed_round(pct_off(F.col("modal_price"), F.col("avg_7d")), 2)
    return means.withColumn("pct_change_7d", pct).withColumn(
        "trend", trend_label(F.col("pct_change_7d"), fall, rise)
    )


def trend_distribution(gold_rows: DataFrame) -> DataFrame:
    return gold_rows.groupBy(*SERIES, "trend").agg(F.count("*").alias("rows"))
