"""Actual and forecast prices on one date axis, and the bounded preview of a result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketboard.config import FORECAST_PERIODS, SERIES
from marketboard.operators.latest import tail_of_series


def outlook(
    rows: DataFrame, forecasts: DataFrame, history: int = 10, periods: int = FORECAST_PERIODS
) -> DataFrame:
    """Last `history` actual prices and the forecast of each series: kind, date, price and band.

    kind is actual, forecast, or connector: the two ends of the line from the last actual price to
    the first forecast one.
    """
    actual = tail_of_series(rows, history).select(
        *SERIES, F.lit("actual").alias("kind"), "date", F.col("modal_price").alias("price"), "pos"
    )
    ahead = forecasts.filter(F.col("pos") <= periods).select(
        *SERIES, F.lit("forecast").alias("kind"), F.col("ds").alias("date"),
        F.col("yhat").alias("price"), "yhat_lower", "yhat_upper", "pos",
    )
    last = actual.groupBy(*SERIES).agg(
        F.max("date").alias("date"), F.max_by("price", "date").alias("price")
    )
    first = ahead.filter(F.col("pos") == 1).select(*SERIES, "date", "price")
    # a connector needs both of its ends
    ends = last.join(first.select(*SERIES), SERIES, "left_semi").unionByName(
        first.join(last.select(*SERIES), SERIES, "left_semi")
    )
    joined = ends.withColumn("kind", F.lit("connector"))
    return (
        actual.drop("pos")
        .unionByName(ahead.drop("pos"), allowMissingColumns=True)
        .unionByName(joined, allowMissingColumns=True)
    )


def concat_all(parts: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name; columns that a part lacks become NULL."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def preview(result: DataFrame, order: Sequence[str], rows: int = 20) -> DataFrame:
    """The first rows as text, NULL shown as a dash, beside the row count of the whole result."""
    total = result.agg(F.count("*")).scalar()
    shown = result.orderBy(*order).limit(rows)
    return shown.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("—")).alias(c) for c in result.columns],
        total.alias("row_count"),
    )
