import datetime as dt
import itertools
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import plan_of
from marketboard.functions.numbers import exact_mean, fixed
from marketboard.operators import audit, features, latest

SILVER = "date date, crop string, mandi string, modal_price double"
DAY = dt.date(2026, 1, 1)


def series(spark, prices, crop="Onion", mandi="Nashik", start=DAY, step=1):
    rows = [(start + dt.timedelta(days=i * step), crop, mandi, float(p)) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, SILVER)


def half_up(x):
    return float(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP))


@pytest.mark.parametrize("length", [1, 6, 7, 8, 30, 31])
def test_trailing_means_count_rows_not_days(spark, length):
    prices = [100 + (i * 37) % 23 + i / 4 for i in range(length)]
    got = features.gold(series(spark, prices, step=3)).orderBy("date").collect()
    for i, row in enumerate(got):
        for column, size in (("avg_7d", 7), ("avg_30d", 30)):
            part = [Decimal(str(p)) for p in prices[max(0, i - size + 1) : i + 1]]
            assert row[column] == half_up(sum(part) / len(part))


def test_pct_recomputes_from_the_rounded_mean(spark):
    for row in features.gold(series(spark, [90, 111, 100, 87, 130, 99.5])).collect():
        pct = (row["modal_price"] - row["avg_7d"]) / row["avg_7d"] * 100
        assert abs(row["pct_change_7d"] - pct) <= 0.005 + 1e-9


def test_trend_limits_are_inclusive(spark):
    cases = {-5.0: "FALLING", 5.0: "RISING", -4.99: "STABLE", 4.99: "STABLE", None: "STABLE"}
    df = spark.createDataFrame([(k,) for k in cases], "pct double")
    assert dict(df.select("pct", features.trend_label(F.col("pct"))).collect()) == cases


def test_both_frames_share_one_sort_and_one_exchange(spark):
    plan = plan_of(features.gold(series(spark, [1, 2, 3]))).split("Initial Plan")[0]
    assert plan.count("Exchange") == 1
    assert plan.count("Sort [") == 1
    assert "Python" not in plan and "PandasUDF" not in plan


def test_exact_mean_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.01), ("b", None), ("c", float("nan")), ("c", 2.0)], "k string, v double")
    got = dict(df.groupBy("k").agg(exact_mean(F.col("v"))).collect())
    assert got == {"a": 1.01, "b": None, "c": 2.0}


def test_exact_mean_of_large_values(spark):
    rows = [("a", 2e14)] * 50_000 + [("b", 2e14), ("b", 2e14 + 1), ("c", 3e30), ("c", float("inf")), ("c", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = dict(df.groupBy("k").agg(exact_mean(F.col("v"))).collect())
    # no text of a number in between: what is too large to count is left out like NaN
    assert got == {"a": 2e14, "b": 2e14 + 0.5, "c": 1.0}
    over = df.filter("k <> 'a'").withColumn("m", exact_mean(F.col("v"), over=Window.partitionBy("k")))
    assert {(r["k"], r["m"]) for r in over.collect()} == {("b", 2e14 + 0.5), ("c", 1.0)}


def test_exact_mean_rounds_half_up_from_whole_units(spark):
    for some in itertools.combinations_with_replacement([0.0, 0.01, 0.0149, 0.015, 1.005, 99.9999], 3):
        df = spark.createDataFrame([(v,) for v in some], "v double").coalesce(1)
        exact = sum(Decimal(str(v)) for v in some) / 3
        assert df.agg(exact_mean(F.col("v"))).first()[0] == float(exact.quantize(Decimal("0.01"), ROUND_HALF_UP)), some


def test_fixed_text(spark):
    df = spark.createDataFrame([(-12.75,), (4.0,), (-0.04,)], "v double")
    assert [r[0] for r in df.select(fixed(F.col("v"), 1, signed=True)).collect()] == ["-12.8", "+4.0", "+0.0"]


@pytest.fixture(scope="module")
def board(spark):
    """Pune stops two days before Nashik, Tomato one day before that."""
    return (
        series(spark, [10, 11, 12, 13])
        .unionByName(series(spark, [20, 21], mandi="Pune"))
        .unionByName(series(spark, [30], crop="Tomato"))
    )


def test_three_readings_of_latest(spark, board):
    per_series = latest.latest_per_series(board).collect()
    assert {(r["crop"], r["mandi"]): r["modal_price"] for r in per_series} == {
        ("Onion", "Nashik"): 13.0, ("Onion", "Pune"): 21.0, ("Tomato", "Nashik"): 30.0,
    }
    per_crop = latest.at_crop_date(board).collect()
    assert {(r["crop"], r["mandi"]) for r in per_crop} == {("Onion", "Nashik"), ("Tomato", "Nashik")}
    whole = latest.at_table_date(board).collect()
    assert [(r["crop"], r["mandi"]) for r in whole] == [("Onion", "Nashik")]
    # targets are applied after the date: nothing is left for Tomato on the table's last date
    assert latest.at_table_date(board, ["Tomato"]).count() == 0


def test_price_maps(spark, board):
    assert latest.price_board_map(latest.latest_per_series(board)).first()["board"] == {
        "Onion": {"Nashik": 13.0, "Pune": 21.0}, "Tomato": {"Nashik": 30.0},
    }


def test_tail_and_point_and_preview(spark, board):
    tail = latest.tail_of_series(board, 2).filter("mandi = 'Nashik' AND crop = 'Onion'").orderBy("pos")
    assert [(r["pos"], r["modal_price"]) for r in tail.collect()] == [(1, 12.0), (2, 13.0)]
    assert latest.point(board, "Onion", "Pune").count() == 2
    assert latest.point(board, "x' OR '1'='1", "Pune").count() == 0
    assert latest.newest_rows(board, 1).first()["modal_price"] == 13.0


def test_counts(spark, board):
    got = {(r["crop"], r["mandi"]): r for r in audit.coverage(board).collect()}
    row = got[("Onion", "Nashik")]
    assert (row["rows"], row["from_date"], row["avg_price"]) == (4, DAY, 11.5)
    profile = audit.value_profile(board).filter("field = 'mandi'").collect()
    assert {(r["value"], r["rows"]) for r in profile} == {("Nashik", 5), ("Pune", 2)}
    trends = features.trend_distribution(features.gold(board)).collect()
    assert sum(r["rows"] for r in trends) == 7
