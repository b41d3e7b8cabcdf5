"""The three readings of "latest", and the tail of a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketboard.config import SERIES
from marketboard.operators.clean import keep_targets


def latest_per_series(rows: DataFrame) -> DataFrame:
    """Each series at its own last date. An aggregate: one row per series leaves each map task."""
    others = [c for c in rows.columns if c not in SERIES]
    newest = F.max_by(F.struct(*others), F.col("date")).alias("_newest")
    picked = rows.groupBy(*SERIES).agg(newest)
    return picked.select(
        *[F.col(c) if c in SERIES else F.col(f"_newest.{c}").alias(c) for c in rows.columns]
    )


def at_table_date(
    rows: DataFrame, crops: Sequence[str] | None = None, mandis: Sequence[str] | None = None
) -> DataFrame:
    """Rows at the last date of the whole table; the targets are applied after the date is known.

    The date comes in as a scalar subquery, so it reaches the scan as a filter.
    """
    last = rows.agg(F.max("date")).scalar()
    return keep_targets(rows.filter(F.col("date") == last), crops, mandis)


def at_crop_date(rows: DataFrame, mandis: Sequence[str] | None = None) -> DataFrame:
    """Rows of each crop at that crop's own last date, then only the listed mandis.

    `rows` is unique per date and series, as the silver and gold tables are. A row at the last date
    of its crop is then the last of its series, so one aggregate over the table finds the
    candidates and the dates compare among one row per series.
    """
    newest = latest_per_series(rows).withColumn(
        "_last", F.max("date").over(Window.partitionBy("crop"))
    )
    return keep_targets(newest.filter(F.col("date") == F.col("_last")).drop("_last"), None, mandis)


def price_board(rows: DataFrame) -> DataFrame:
    """One row per crop with a sorted map mandi -> price.

    Give it rows of one date per crop (at_table_date, at_crop_date): a map then holds at most one
    entry per market.
    """
    pairs = F.array_sort(F.collect_list(F.struct("mandi", "modal_price")))
    return rows.groupBy("crop").agg(F.map_from_entries(pairs).alias("prices"))


def price_board_map(rows: DataFrame) -> DataFrame:
    """The whole board as one nested map crop -> mandi -> price, one entry per target crop."""
    by_crop = F.array_sort(
        F.collect_list(F.struct("crop", "prices")),
        lambda a, b: F.when(a["crop"] < b["crop"], -1).when(a["crop"] > b["crop"], 1).otherwise(0),
    )
    return price_board(rows).agg(F.map_from_entries(by_crop).alias("board"))


def tail_of_series(rows: DataFrame, count: int) -> DataFrame:
    """The last `count` rows of each series, with pos = 1..count in date order."""
    newest = Window.partitionBy(*SERIES).orderBy(F.col("date").desc())
    kept = rows.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= count)
    oldest = Window.partitionBy(*SERIES).orderBy("date")
    return kept.withColumn("pos", F.row_number().over(oldest)).drop("_back")


def newest_rows(rows: DataFrame, count: int = 10) -> DataFrame:
    """Newest-first preview of a table."""
    return rows.orderBy(F.col("date").desc(), *SERIES).limit(count)


def point(rows: DataFrame, crop: str, mandi: str) -> DataFrame:
    """Rows of one series. Values are bound as literals, never spliced into SQL text."""
    return rows.filter((F.col("crop") == F.lit(crop)) & (F.col("mandi") == F.lit(mandi)))


def as_series(rows: DataFrame) -> DataFrame:
    """The forecasting view of a price table: ds and y."""
    return rows.select(*SERIES, F.col("date").alias("ds"), F.col("modal_price").alias("y"))
