"""The advisory board: one plan that answers every series at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketboard.config import PROTECTED_TERMS, SERIES
from marketboard.functions.numbers import fixed
from marketboard.functions.text import filled
from marketboard.operators.advice import (
    Translator,
    in_languages,
    mask_texts,
    route_texts,
    with_recommendation,
)
from marketboard.operators.latest import at_crop_date, latest_per_series, price_board
from marketboard.operators.retrieval import context_text, ranked_lists
from marketboard.operators.signals import verdicts


# The texts of a board that are translated.
TEXTS = ("recommendation", "advisory_text")


def crop_passages(passages: DataFrame) -> DataFrame:
    """One row per crop_key: its context block, its first passage and that passage's source."""
    first = F.get("passages", F.lit(0))
    return ranked_lists(passages, ["crop_key"]).select(
        "crop_key",
        context_text(F.col("passages")).alias("context"),
        first["text"].alias("advisory_text"),
        F.concat(
            F.lit("Source: "), filled(first["source_doc"], "unknown"),
            F.lit(" | Page "), filled(first["page"], "?"),
        ).alias("advisory_source"),
    )


def advisory_rows(
    gold: DataFrame,
    signals: DataFrame,
    passages: DataFrame,
    languages: Sequence[str] = ("English",),
    outlook: DataFrame | None = None,
    terms: Sequence[str] = PROTECTED_TERMS,
    make_translator: Callable[[], Translator] | None = None,
) -> DataFrame:
    """Flat advisory rows, one per series and language.

    Both TEXTS go through one route: see route_texts for sources, placeholders, texts and translated, maps by the name of the
    text. passages is a retrieval result with crop_key and rank. A crop without passages keeps NULL
    advisory columns. outlook rows, if given, are nested in date order; a series has at most its
    history, its horizon and two connector ends of them.
    """
    decided = verdicts(latest_per_series(gold), signals).withColumn("crop_key", F.lower("crop"))
    advised = decided.join(crop_passages(passages), "crop_key", "left")
    prices = price_board(at_crop_date(gold)).withColumn(
        "all_prices", F.transform_values("prices", lambda _, p: p.cast("bigint"))
    )
    full = with_recommendation(advised).join(prices.drop("prices"), "crop", "left")
    if outlook is not None:
        points = F.struct("date", "kind", "price", "yhat_lower", "yhat_upper")
        nested = outlook.groupBy(*SERIES).agg(
            F.array_sort(F.collect_list(points)).alias("outlook")
        )
        full = full.join(nested, SERIES, "left")
    masked = mask_texts(full, TEXTS, terms)
    return route_texts(in_languages(masked, languages), TEXTS, terms=terms, make_translator=make_translator)


def board_records(rows: DataFrame) -> DataFrame:
    """Advisory rows in the shape that a board shows."""
    optional = [c for c in ("outlook",) if c in rows.columns]
    return rows.select(
        *SERIES,
        "language",
        "decision",
        "confidence",
        F.col("modal_price").cast("bigint").alias("modal_price"),
        fixed(F.col("pct_change_7d"), 1, signed=True).alias("pct_change"),
        "trend",
        F.concat(
            F.col("signal"), F.lit(" — "), fixed(F.col("rain_3d_mm"), 1), F.lit(" mm")
        ).alias("weather"),
        "recommendation",
        F.col("sources")["recommendation"].alias("source_text"),
        "language_code",
        "advisory_text",
        "advisory_source",
        "context",
        "all_prices",
        "sources",
        "placeholders",
        "texts",
        "translated",
        *optional,
    )


def advisory_board(gold: DataFrame, signals: DataFrame, passages: DataFrame, **kwargs) -> DataFrame:
    return board_records(advisory_rows(gold, signals, passages, **kwargs))
