"""Raw price rows -> one clean row per date and series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketboard.config import CROP_ALIASES, SERIES
from marketboard.functions.dates import ISO, parsed_date
from marketboard.functions.names import canonical_name

KEY_COLUMNS = ["date", *SERIES, "modal_price"]


def normalise_crops(raw: DataFrame, aliases: Mapping[str, str] = CROP_ALIASES) -> DataFrame:
    return raw.withColumn("crop", canonical_name(F.col("crop"), aliases))


def normalise_crops_by_table(raw: DataFrame, aliases: DataFrame) -> DataFrame:
    """Same as normalise_crops for alias sets too large for a literal: columns alias, name.

    Plain left join: Spark broadcasts the alias table if it measures small and otherwise shuffles,
    splitting hot names by its skew-join rule.
    """
    # Spellings of one alias that disagree: the smallest name, whatever the order of the rows.
    lookup = aliases.groupBy(F.lower("alias").alias("_alias")).agg(F.min("name").alias("_name"))
    joined = raw.join(lookup, F.lower(raw["crop"]) == lookup["_alias"], "left")
    return joined.withColumn("crop", F.coalesce("_name", F.initcap("crop"))).drop("_alias", "_name")


def typed_dates(raw: DataFrame, formats: Sequence[str] = (ISO,)) -> DataFrame:
    return raw.withColumn("date", parsed_date(F.col("date"), formats))


def complete_rows(rows: DataFrame, required: Sequence[str] = KEY_COLUMNS) -> DataFrame:
    """Drop rows in which a required column is NULL or NaN."""
    return rows.dropna(subset=list(required))


def keep_targets(
    rows: DataFrame, crops: Sequence[str] | None, mandis: Sequence[str] | None
) -> DataFrame:
    """Rows of the listed crops and mandis (exact spelling); None lists nothing out."""
    if crops is not None:
        rows = rows.filter(F.col("crop").isin(list(crops)))
    if mandis is not None:
        rows = rows.filter(F.col("mandi").isin(list(mandis)))
    return rows


def keep_targets_by_table(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """keep_targets for long lists: a semi join on (crop, mandi)."""
    return rows.join(targets.select(*SERIES), SERIES, "left_semi")


def positive_prices(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("modal_price") > 0)


def clean(
    raw: DataFrame,
    crops: Sequence[str] | None = None,
    mandis: Sequence[str] | None = None,
    aliases: Mapping[str, str] = CROP_ALIASES,
    formats: Sequence[str] = (ISO,),
) -> DataFrame:
    rows = typed_dates(normalise_crops(raw, aliases), formats)
    return positive_prices(keep_targets(complete_rows(rows), crops, mandis))


def best_price_per_day(rows: DataFrame) -> DataFrame:
    """One row per (date, crop, mandi): the highest price, ties settled by the other columns.

    Written as an aggregate, so each map task sends at most one row per key however many copies
    of a key it holds.
    """
    keys = ["date", *SERIES]
    others = [c for c in rows.columns if c not in (*keys, "modal_price")]
    best = F.max(F.struct("modal_price", *others)).alias("_best")
    picked = rows.groupBy(*keys).agg(best)
    return picked.select(
        *[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in rows.columns]
    )


def silver(raw: DataFrame, **kwargs) -> DataFrame:
    return best_price_per_day(clean(raw, **kwargs))
