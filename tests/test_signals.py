import json

import pytest

from marketboard.operators import signals

TREND = (
    "crop string, mandi string, date string, modal_price double, avg_7d double, avg_30d double, "
    "pct_change_7d double, trend string"
)


def decide(spark, pct, trend, signal, mm):
    row = spark.createDataFrame(
        [("Onion", "Nashik", "2024-10-15", 820.0, 940.0, 1050.0, pct, trend)], TREND
    )
    weather = spark.createDataFrame(
        [("Nashik", mm, signal, "test")],
        "mandi string, rain_3d_mm double, signal string, description string",
    )
    return signals.as_verdict_structs(signals.verdicts(row, weather)).first()


@pytest.mark.parametrize(
    "pct,trend,signal,mm,decision,confidence",
    [
        (-13.0, "FALLING", "WET", 7.0, "SELL NOW", "HIGH"),
        (-10.0, "FALLING", "DRY", 0.0, "SELL SOON", "MEDIUM"),
        (8.0, "RISING", "DRY", 0.0, "HOLD", "HIGH"),
        (6.0, "RISING", "WET", 8.0, "HOLD SHORT", "MEDIUM"),
        (2.0, "STABLE", "DRY", 0.0, "MONITOR", "LOW"),
    ],
)
def test_rules(spark, pct, trend, signal, mm, decision, confidence):
    got = decide(spark, pct, trend, signal, mm)
    assert (got["decision"], got["confidence"]) == (decision, confidence)


def test_verdict_fields_and_reason(spark):
    got = decide(spark, -5.0, "FALLING", "WET", 6.0)
    assert got.asDict().keys() == {"decision", "confidence", "reason_en", "price_trend", "weather"}
    assert got["reason_en"] == (
        "Price fell 5.0% in 7 days and 6.0mm rain forecast — storage losses likely."
    )
    assert got["price_trend"]["modal_price"] == 820.0 and got["weather"]["mandi"] == "Nashik"


def test_own_rules_table(spark):
    rules = spark.createDataFrame(
        [("STABLE", "DRY", "WAIT", "HIGH")],
        "trend string, signal string, decision string, confidence string",
    )
    rows = spark.createDataFrame(
        [("STABLE", "DRY", 0.0, 0.0), ("RISING", "DRY", 9.0, 0.0)],
        "trend string, signal string, pct_change_7d double, rain_3d_mm double",
    )
    got = {r["trend"]: r["decision"] for r in signals.decide(rows, rules).collect()}
    assert got == {"STABLE": "WAIT", "RISING": "MONITOR"}


def doc(*mm):
    return json.dumps({"list": [{} if x is None else {"rain": {"3h": x}} for x in mm]})


def test_weather_signals(spark):
    rows = spark.createDataFrame(
        [
            ("below", doc(4.96)), ("at", doc(2.5, None, 2.5)), ("dry", doc(None, None)),
            ("empty", "{}"), ("none", None), ("odd", json.dumps({"list": [{"rain": {}}]})),
        ],
        "mandi string, document string",
    )
    got = {r["mandi"]: r for r in signals.weather_signals(rows).collect()}
    assert (got["below"]["signal"], got["below"]["rain_3d_mm"]) == ("DRY", 5.0)
    assert (got["at"]["signal"], got["at"]["rain_3d_mm"]) == ("WET", 5.0)
    for name in ("dry", "empty", "none", "odd"):
        assert (got[name]["signal"], got[name]["rain_3d_mm"]) == ("DRY", 0.0)
    assert got["none"]["description"] == "No weather data available for none."
    assert got["at"]["description"] == "5.0 mm rain forecast over next 3 days near at"


def test_unknown_market_is_dry(spark):
    rows = spark.createDataFrame([("here",), ("there",)], "mandi string")
    known = signals.weather_signals(
        spark.createDataFrame([("here", doc(9.0))], "mandi string, document string")
    )
    got = {r["mandi"]: r for r in signals.with_weather(rows, known).collect()}
    assert got["here"]["signal"] == "WET"
    assert (got["there"]["signal"], got["there"]["rain_3d_mm"]) == ("DRY", 0.0)
    assert got["there"]["description"] == "No weather data available for there."


def test_trend_only_verdict(spark):
    rows = spark.createDataFrame(
        [("Pune", "FALLING", -6.3), ("Pune", "RISING", 7.1), ("Pune", "STABLE", 0.0)],
        "mandi string, trend string, pct_change_7d double",
    )
    got = {r["trend"]: (r["decision"], r["confidence"], r["reason_en"]) for r in signals.trend_verdicts(rows).collect()}
    assert got["FALLING"] == ("SELL SOON", "MEDIUM", "Price is down 6.3% over 7 days at Pune. Sell within 3-5 days.")
    assert got["RISING"][:2] == ("HOLD", "HIGH") and got["STABLE"][:2] == ("MONITOR", "LOW")


def test_lookup_default(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "k string")
    table = spark.createDataFrame([("a", 1)], "k string, v int")
    got = dict(signals.lookup_or_default(rows, table, "k", {"v": 0}).collect())
    assert got == {"a": 1, "b": 0}
