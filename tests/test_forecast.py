import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from marketboard.operators import forecast, outlook, runs, series

SERIES = "crop string, mandi string, ds date, y double"
DAY = dt.date(2026, 1, 1)


def prices(n, crop, seed):
    rng = np.random.default_rng(seed)
    return [
        (crop, "m", DAY + dt.timedelta(days=i), round(float(900 + 3 * i + 40 * (i % 7) + rng.normal(0, 9)), 2))
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def table(spark):
    rows = prices(29, "short", 1) + prices(45, "middle", 2) + prices(90, "long", 3)
    return spark.createDataFrame(rows, SERIES).cache()


@pytest.fixture(scope="module")
def models(table):
    return forecast.train(table).cache()


def by_hand(rows, ahead):
    """The definition in numpy: line, weekday ratios, spread of the residuals."""
    x = np.array([(r[2] - rows[0][2]).days for r in rows], dtype=float)
    y = np.array([r[3] for r in rows])
    b, a = np.polyfit(x, y, 1)
    line = a + b * x
    wd = np.array([(r[2].isoweekday()) % 7 for r in rows])
    factor = {d: np.mean(y[wd == d] / line[wd == d]) for d in set(wd)}
    fit = line * np.array([factor[d] for d in wd])
    sigma = np.sqrt(np.mean((y - fit) ** 2))
    last = rows[-1][2]
    out = []
    for i in range(1, ahead + 1):
        ds = last + dt.timedelta(days=i)
        out.append((a + b * (ds - rows[0][2]).days) * factor.get(ds.isoweekday() % 7, 1.0))
    return np.array(out), sigma


def test_short_series_get_no_model(models):
    assert {r["crop"] for r in models.collect()} == {"middle", "long"}


def test_fit_forecast_and_band_follow_the_definition(models):
    rows = prices(90, "long", 3)[:60]
    want, sigma = by_hand(rows, 10)
    got = forecast.forecast(models).filter("crop = 'long'").orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(1, 11))
    assert got[0]["ds"] == rows[-1][2] + dt.timedelta(days=1)
    np.testing.assert_allclose([r["yhat"] for r in got], want, rtol=1e-9)
    np.testing.assert_allclose([r["yhat_upper"] - r["yhat"] for r in got], 1.2816 * sigma, rtol=1e-6)


def test_holdout_metrics(table, models):
    got = {r["crop"]: r for r in forecast.evaluate(table, models).collect()}
    assert (got["middle"]["mape"], got["middle"]["mae"]) == (999.0, 999.0)
    rows = prices(90, "long", 3)
    want, _ = by_hand(rows[:60], 30)
    y = np.array([r[3] for r in rows[60:]])
    assert got["long"]["mape"] == round(float(np.mean(np.abs((y - want) / y)) * 100), 2)
    assert got["long"]["mae"] == round(float(np.mean(np.abs(y - want))), 2)


def test_backtest_pairs_by_date(spark, table, models):
    detail = forecast.backtest(table, models).orderBy("date").collect()
    rows = prices(90, "long", 3)
    want, _ = by_hand(rows[:60], 30)
    assert [r["crop"] for r in detail] == ["long"] * 30
    assert [r["actual"] for r in detail] == [int(r[3]) for r in rows[60:]]
    assert [r["predicted"] for r in detail] == [int(v) for v in want]
    summary = forecast.backtest_summary(forecast.backtest(table, models)).first()
    assert abs(summary["mape"] - np.mean([abs(r["error_pct"]) for r in detail])) <= 0.0051


def test_date_gap_separates_the_two_pairings(spark):
    rows = prices(60, "gap", 5) + [("gap", "m", DAY + dt.timedelta(days=100), 1000.0)]
    table = spark.createDataFrame(rows, SERIES)
    models = forecast.train(table)
    ten = forecast.forecast(models, 10)
    held = series.test_part(table)
    by_position = series.pair_by_position(held, ten).collect()
    assert [(r["pos"], (r["ds"] - DAY).days, (r["forecast_ds"] - DAY).days) for r in by_position] == [(1, 100, 60)]
    assert series.pair_by_date(held, ten).count() == 0
    assert forecast.backtest(table, models).count() == 1  # the horizon reaches the last test date


def test_constant_dates_and_zero_line_do_not_fail(spark):
    rows = [("flat", "m", DAY + dt.timedelta(days=i), 5.0) for i in range(30)]
    got = forecast.forecast(forecast.train(spark.createDataFrame(rows, SERIES)), 2).collect()
    assert [round(r["yhat"], 9) for r in got] == [5.0, 5.0]
    one = spark.createDataFrame([("one", "m", DAY, 7.0)], SERIES)
    got = forecast.forecast(forecast.train(one, min_rows=1), 1).first()
    assert got["yhat"] == 7.0


def test_last_periods(models):
    got = forecast.last_periods(forecast.forecast(models, 20), 3).filter("crop = 'long'").collect()
    assert sorted(r["pos"] for r in got) == [18, 19, 20]


def test_ledger_and_choice(table):
    rows = [
        runs.ledger(
            forecast.evaluate(table, forecast.train(table, n), n), {"train_days": n}, 1000 + n, 2000, "models/"
        )
        for n in (30, 60)
    ]
    ledger = outlook.concat_all(rows)
    assert ledger.select("run_id").distinct().count() == ledger.count() == 4
    one = ledger.filter("crop = 'long' AND start_time = 1060").first()
    assert one["params"] == {"crop": "long", "mandi": "m", "train_days": "60"}
    assert set(one["metrics"]) == {"MAPE", "MAE"} and one["tags"] == {"model_path": "models/long_m"}
    summary = runs.run_summary(ledger)
    listed = [r["mape"] for r in runs.ranked_runs(summary, 20.0).collect()]
    assert listed == sorted(listed)
    assert runs.best_run(summary).first()["mape"] == listed[0]
    per_series = {r["crop"]: r["mape"] for r in runs.best_run_per_series(summary).collect()}
    for crop, best in per_series.items():
        assert best == summary.filter(F.col("crop") == crop).agg(F.min("mape")).first()[0]


def test_outlook(spark, table, models):
    daily = table.select("crop", "mandi", F.col("ds").alias("date"), F.col("y").alias("modal_price"))
    got = outlook.outlook(daily, forecast.forecast(models), 10, 10).filter("crop = 'long'").collect()
    kinds = [r["kind"] for r in got]
    assert (kinds.count("actual"), kinds.count("forecast"), kinds.count("connector")) == (10, 10, 2)
    ends = sorted((r["date"], r["price"]) for r in got if r["kind"] == "connector")
    assert ends[1] == max((r["date"], r["price"]) for r in got if r["kind"] == "actual")
    short = outlook.outlook(daily, forecast.forecast(models)).filter("crop = 'short'").collect()
    assert {r["kind"] for r in short} == {"actual"}


def test_preview(spark):
    rows = spark.createDataFrame([(i, None if i == 0 else str(i)) for i in range(50)], "i int, v string")
    got = outlook.preview(rows, ["i"]).collect()
    assert len(got) == 20 and got[0]["v"] == "—" and {r["row_count"] for r in got} == {50}


def test_a_third_key_makes_series_of_its_own(spark):
    import datetime

    day = datetime.date(2024, 1, 1)
    rows = [("Onion", "Pune", g, day + datetime.timedelta(i), 100.0 + i) for g in "AB" for i in range(40)]
    table = spark.createDataFrame(rows, "crop string, mandi string, grade string, ds date, y double")
    keys = ["crop", "mandi", "grade"]
    assert series.train_part(table, 30, keys).groupBy("grade").count().filter("count = 30").count() == 2
    assert series.test_part(table, 30, keys).groupBy("grade").count().filter("count = 10").count() == 2


def test_served_forecasts_follow_the_last_actual(table):
    models = forecast.train(table, None)
    last = table.groupBy("crop", "mandi").agg(F.max("ds").alias("last"), F.count("*").alias("n"))
    both = models.join(last, ["crop", "mandi"])
    assert models.count() > 0 and both.filter("last_train <> last OR n_train <> n").count() == 0
    ahead = forecast.forecast(models).join(last, ["crop", "mandi"])
    assert ahead.filter("ds <= last").count() == 0


def test_whole_series_fit_is_made_of_partial_sums(table):
    plan = plan_of(forecast.train(table, None)).split("Initial Plan")[0]
    assert "Window" not in plan and "partial_regr" in plan
    assert "partial_sum" in plan and "CartesianProduct" not in plan


def test_whole_series_fit_equals_the_ranked_one(table):
    """A rank filter that lets all rows pass gives the same models by another plan."""
    got, want = ({r["crop"]: r for r in forecast.train(table, n).collect()} for n in (None, 1000))
    assert got.keys() == want.keys() == {"middle", "long"}
    for crop, one in got.items():
        rows = prices(45, "middle", 2) if crop == "middle" else prices(90, "long", 3)
        _, sigma = by_hand(rows, 1)
        assert one["sigma"] == pytest.approx(sigma, rel=1e-9)
        for column in ("intercept", "slope", "sigma"):
            assert one[column] == pytest.approx(want[crop][column], rel=1e-9)
        assert one["weekday_factors"] == pytest.approx(want[crop]["weekday_factors"])


def test_a_perfect_fit_has_no_spread(spark):
    rows = [("line", "m", DAY + dt.timedelta(days=i), 100.0 + 2 * i) for i in range(70)]
    got = forecast.train(spark.createDataFrame(rows, SERIES), None).first()
    assert 0 <= got["sigma"] < 1e-5 and got["slope"] == pytest.approx(2.0) and got["intercept"] == pytest.approx(100.0)
