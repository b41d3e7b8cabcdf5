"""Rain signals from stored forecast documents, and the sell/hold verdict."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketboard.config import DEFAULT_VERDICT, RAIN_THRESHOLD_MM, SERIES, VERDICT_RULES
from marketboard.functions.numbers import fixed, signed_round

FORECAST_SCHEMA = "struct<list: array<struct<rain: struct<`3h`: double>>>>"


def rain_total(document: Column) -> Column:
    """Sum of all three-hour slots of a forecast document; a slot without rain counts 0."""
    slots = F.from_json(document, FORECAST_SCHEMA)["list"]
    total = F.aggregate(
        F.coalesce(slots, F.array().cast("array<struct<rain: struct<`3h`: double>>>")),
        F.lit(0.0),
        lambda acc, slot: acc + F.coalesce(slot["rain"]["3h"], F.lit(0.0)),
    )
    return F.when(document.isNotNull(), total)


def weather_signals(documents: DataFrame, threshold: float = RAIN_THRESHOLD_MM) -> DataFrame:
    """Add rain_3d_mm, signal and description to rows of (mandi, document, ...).

    The threshold meets the total before rounding; the report shows it rounded.
    """
    rows = documents.withColumn("_mm", rain_total(F.col("document")))
    known = F.col("_mm").isNotNull()
    shown = F.when(known, signed_round(F.col("_mm"), 1)).otherwise(F.lit(0.0))
    return rows.withColumns(
        {
            "rain_3d_mm": shown,
            "signal": F.when(F.col("_mm") >= threshold, "WET").otherwise("DRY"),
            "description": F.when(
                known,
                F.concat(
                    fixed(F.col("_mm"), 1),
                    F.lit(" mm rain forecast over next 3 days near "),
                    F.col("mandi"),
                ),
            ).otherwise(no_data_text(F.col("mandi"))),
        }
    ).drop("_mm", "document")


def no_data_text(mandi: Column) -> Column:
    return F.concat(F.lit("No weather data available for "), mandi, F.lit("."))


def with_weather(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """Left join on mandi; a market without a signal is dry.

    `signals` holds one row per market. No broadcast is forced: Spark measures that side and splits
    hot markets itself when it has to shuffle.
    """
    side = signals.select("mandi", "rain_3d_mm", "signal", "description")
    joined = rows.join(side, "mandi", "left")
    return joined.withColumns(
        {
            "rain_3d_mm": F.coalesce("rain_3d_mm", F.lit(0.0)),
            "signal": F.coalesce("signal", F.lit("DRY")),
            "description": F.coalesce("description", no_data_text(F.col("mandi"))),
        }
    )


def rules_table(spark, rules: Mapping = VERDICT_RULES) -> DataFrame:
    """The decision rules as rows; as long as the literal they come from."""
    rows = [(*key, *value) for key, value in rules.items()]
    return spark.createDataFrame(
        rows, "trend string, signal string, decision string, confidence string"
    )


def verdict_reason(decision: Column, pct: Column, mm: Column) -> Column:
    """Text of the reason that goes with a decision."""
    size, rain = fixed(F.abs(pct), 1), fixed(mm, 1)
    signed = fixed(pct, 1)
    # ---- fixed values: wording of the reasons -----------------------------------------------
    return (
        F.when(
            decision == "SELL NOW",
            F.concat(
                F.lit("Price fell "), size, F.lit("% in 7 days and "), rain,
                F.lit("mm rain forecast — storage losses likely."),
            ),
        )
        .when(
            decision == "SELL SOON",
            F.concat(
                F.lit("Price down "), size,
                F.lit("% over 7 days. Dry weather allows short storage — sell within 3-5 days."),
            ),
        )
        .when(
            decision == "HOLD",
            F.concat(
                F.lit("Price up "), signed,
                F.lit("% in 7 days. Dry weather favours continued gains."),
            ),
        )
        .when(
            decision == "HOLD SHORT",
            F.concat(
                F.lit("Price rising ("), signed, F.lit("%) but "), rain,
                F.lit("mm rain expected — hold 2-3 days max."),
            ),
        )
        .otherwise(F.lit("Price is stable. Monitor over next 3 days before deciding."))
    )


def decide(rows: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Add decision, confidence and reason_en to rows with trend, signal, pct and rain.

    The default rules are a four-row literal, hence the broadcast. A rules table of the caller's own
    joins without a hint.
    """
    if rules is None:
        rules = F.broadcast(rules_table(rows.sparkSession))
    joined = rows.join(rules, ["trend", "signal"], "left")
    decided = joined.withColumns(
        {
            "decision": F.coalesce("decision", F.lit(DEFAULT_VERDICT[0])),
            "confidence": F.coalesce("confidence", F.lit(DEFAULT_VERDICT[1])),
        }
    )
    return decided.withColumn(
        "reason_en",
        verdict_reason(F.col("decision"), F.col("pct_change_7d"), F.col("rain_3d_mm")),
    )


def verdicts(latest: DataFrame, signals: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Flat verdict rows: latest price features, weather, decision, confidence, reason."""
    return decide(with_weather(latest, signals), rules)


def as_verdict_structs(flat: DataFrame) -> DataFrame:
    """Verdicts in nested form: decision, confidence, reason_en, price_trend, weather."""
    trend = F.struct(
        *SERIES, F.col("date").cast("string").alias("date"),
        "modal_price", "avg_7d", "avg_30d", "pct_change_7d", "trend",
    )
    weather = F.struct("mandi", "rain_3d_mm", "signal", "description")
    return flat.select(
        "decision", "confidence", "reason_en",
        trend.alias("price_trend"), weather.alias("weather"),
    )


def trend_verdicts(latest: DataFrame) -> DataFrame:
    """Verdict from the trend alone, with a reason that names the market."""
    trend, pct, mandi = F.col("trend"), F.col("pct_change_7d"), F.col("mandi")
    falling, rising = trend == "FALLING", trend == "RISING"
    # ---- fixed values: decisions and wording ------------------------------------------------
    return latest.withColumns(
        {
            "decision": F.when(falling, "SELL SOON").when(rising, "HOLD").otherwise("MONITOR"),
            "confidence": F.when(falling, "MEDIUM").when(rising, "HIGH").otherwise("LOW"),
            "reason_en": F.when(
                falling,
                F.concat(
                    F.lit("Price is down "), fixed(F.abs(pct), 1), F.lit("% over 7 days at "),
                    mandi, F.lit(". Sell within 3-5 days."),
                ),
            )
            .when(
                rising,
                F.concat(
                    F.lit("Price is up "), fixed(pct, 1), F.lit("% over 7 days at "),
                    mandi, F.lit(". Hold for better returns."),
                ),
            )
            .otherwise(
                F.concat(
                    F.lit("Price is stable at "), mandi, F.lit(". Monitor daily before deciding.")
                )
            ),
        }
    )


def lookup_or_default(
    rows: DataFrame, table: DataFrame, key: str, defaults: Mapping[str, object]
) -> DataFrame:
    """Left join on `key`; columns that found no partner take their default."""
    joined = rows.join(table.select(key, *defaults), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
