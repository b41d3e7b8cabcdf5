"""Trend-times-weekday forecasts of all series in one grouped job.

The model of a series is y = (a + b*x) * s[weekday] with x = days since the first training date,
a least-squares line, weekday factors as the mean ratio to that line, and a normal error band. It
belongs to the same family as the multiplicative weekly model it stands in for, but it is a
different fit; its numbers answer to the definition here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketboard.config import (
    BAND_WIDTH_SIGMAS,
    FORECAST_PERIODS,
    MIN_SERIES_ROWS,
    NO_PAIRS_ERROR,
    SERIES,
    TRAIN_ROWS,
)
from marketboard.functions.dates import days_after
from marketboard.functions.numbers import exact_mean, signed_round
from marketboard.operators.series import (
    error_metrics,
    long_enough,
    test_part,
    train_part,
)


def _weekday(ds: Column) -> Column:
    return F.dayofweek(ds) - F.lit(1)


def train(
    series: DataFrame,
    train_rows: int | None = TRAIN_ROWS,
    min_rows: int = MIN_SERIES_ROWS,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """One model row per series with at least `min_rows` rows.

    `train_rows` None fits the whole series: a forecast to be served follows its last actual price. Its moments are plain
    aggregates: tasks pass on one row for a series, then one for a series and weekday, and lines meet the rows by a join
    on the series. With a rank filter all steps after it keep the partitioning of the series, which then needs one exchange.
    A series with a NULL key gets no model.
    """
    if train_rows is None:
        first = series
    else:
        if min_rows > train_rows:
            series = long_enough(series, min_rows, keys)
        first = train_part(series, train_rows, keys)
    least = min_rows if train_rows is None else min(min_rows, train_rows)
    lines = _lines(first, keys).filter(F.col("n_train") >= least)
    return _models(first.join(lines, list(keys)), keys)


def _lines(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """origin, last_train, n_train, intercept (at the origin) and slope of every series."""
    # Days are counted from a fixed date, as the first one of a series is only known when all its rows have met.
    x, y = F.unix_date(F.col("ds").cast("date")).cast("double"), F.col("y")
    sums = rows.groupBy(*keys).agg(
        F.min("ds").alias("origin"),
        F.max("ds").alias("last_train"),
        F.count("*").alias("n_train"),
        F.avg(F.when(y.isNotNull(), x)).alias("_x"),
        F.avg(y).alias("_y"),
        F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"),
    )
    start = F.unix_date(F.col("origin").cast("date")).cast("double")
    return sums.select(
        *keys, "origin", "last_train", "n_train",
        (F.col("_y") + F.col("slope") * (start - F.col("_x"))).alias("intercept"),
        "slope",
    )


def _models(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One model row per series from its rows, which carry its line: weekday factors and sigma by sums for each weekday.

    The miss is y - line * factor = (y - line) - line * (factor - 1), whose square is a sum of three sums of its parts.
    """
    y = F.col("y")
    line = F.col("intercept") + F.col("slope") * F.datediff("ds", "origin").cast("double")
    off = y - line
    lines = [F.first(c).alias(c) for c in ("origin", "last_train", "n_train", "intercept", "slope")]
    days = rows.groupBy(*keys, _weekday(F.col("ds")).alias("weekday")).agg(
        *lines,
        F.coalesce(F.avg(F.try_divide(y, line)), F.lit(1.0)).alias("_factor"),
        F.count(off).alias("_n"),
        F.sum(off * off).alias("_oo"),
        F.sum(off * line).alias("_ol"),
        F.sum(F.when(off.isNotNull(), line * line)).alias("_ll"),
    )
    more = F.col("_factor") - F.lit(1.0)
    squares = F.col("_oo") - F.lit(2.0) * more * F.col("_ol") + more * more * F.col("_ll")
    return days.groupBy(*keys).agg(
        *lines,
        # at most seven distinct pairs
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("weekday", "_factor")))).alias(
            "weekday_factors"
        ),
        F.sqrt(
            F.greatest(F.try_divide(F.sum(squares), F.sum("_n")), F.lit(0.0))
        ).alias("sigma"),
    )


def yhat(ds: Column) -> Column:
    """Forecast at a date, from the columns of a model row."""
    line = F.col("intercept") + F.col("slope") * F.datediff(ds, F.col("origin")).cast("double")
    return line * F.coalesce(F.col("weekday_factors")[_weekday(ds)], F.lit(1.0))


def forecast(
    models: DataFrame,
    periods: int | Column = FORECAST_PERIODS,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """The `periods` days after the last training date: pos, ds, yhat, yhat_lower, yhat_upper.

    `periods` may be a column of the model rows, to give each series its own horizon.
    """
    count = F.lit(periods) if isinstance(periods, int) else periods
    days = models.select("*", F.posexplode(days_after(F.col("last_train"), count)).alias("_i", "ds"))
    value = days.withColumn("yhat", yhat(F.col("ds")))
    reach = F.lit(BAND_WIDTH_SIGMAS) * F.col("sigma")
    return value.select(
        *keys,
        (F.col("_i") + F.lit(1)).alias("pos"),
        "ds",
        "yhat",
        (F.col("yhat") - reach).alias("yhat_lower"),
        (F.col("yhat") + reach).alias("yhat_upper"),
    )


def evaluate(
    series: DataFrame,
    models: DataFrame,
    train_rows: int = TRAIN_ROWS,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """MAPE and MAE of each model on the rows after its training rows, paired by position.

    The i-th of these rows meets the forecast of the i-th day after training, whatever its own date;
    the model is evaluated there directly, so no forecast rows are made and joined. A model without
    such rows gets the no-pairs error in both columns.
    """
    held_out = test_part(series, train_rows, keys).join(models, list(keys))
    pairs = held_out.withColumn("yhat", yhat(F.date_add("last_train", F.col("pos"))))
    return models.select(*keys).join(error_metrics(pairs, keys), list(keys), "left").withColumns(
        {c: F.coalesce(c, F.lit(NO_PAIRS_ERROR)) for c in ("mape", "mae")}
    )


def backtest(
    series: DataFrame,
    models: DataFrame,
    train_rows: int | None = TRAIN_ROWS,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Actual against forecast by date after the training rows: whole numbers and error %.

    The horizon is the last of these dates, so every one of them has its forecast. With train_rows=None they are the dates
    after each model's own last one: models of runs with different training sizes are each tested on what they have not seen.
    """
    if train_rows is None:
        held_out = series.join(models, list(keys)).filter(F.col("ds") > F.col("last_train"))
    else:
        held_out = test_part(series, train_rows, keys).join(models, list(keys))
    value = held_out.withColumn("yhat", yhat(F.col("ds")))
    return value.select(
        *keys,
        F.col("ds").alias("date"),
        F.col("y").cast("bigint").alias("actual"),
        F.col("yhat").cast("bigint").alias("predicted"),
        signed_round(
            F.try_divide(F.col("y") - F.col("yhat"), F.col("y")) * F.lit(100.0), 1
        ).alias("error_pct"),
    )


def backtest_summary(detail: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """MAPE per series from the errors as reported, one decimal each."""
    return detail.groupBy(*keys).agg(exact_mean(F.abs("error_pct"), scale=2).alias("mape"))


def last_periods(forecasts: DataFrame, count: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """The last `count` days of each forecast."""
    newest = Window.partitionBy(*keys).orderBy(F.col("ds").desc())
    return (
        forecasts.withColumn("_back", F.row_number().over(newest))
        .filter(F.col("_back") <= count)
        .drop("_back")
    )
