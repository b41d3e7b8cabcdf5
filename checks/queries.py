"""One query per operator, over whole tables. Dates, arrays and maps leave as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketboard.config import LANGUAGE_CODES, PROTECTED_TERMS, SERIES
from marketboard.functions.names import canonical_name
from marketboard.functions.numbers import signed_round
from marketboard.functions.text import restore_terms, speech_text
from marketboard.operators import (
    advice,
    audit,
    chunks,
    clean,
    features,
    forecast,
    latest,
    outlook,
    retrieval,
    runs,
    series,
    signals,
    store,
    vectors,
)
from marketboard.plans import board, medallion
from marketboard.sources import dimensions, prices, star, tables
from marketboard.sources.storage import work_path
from marketboard.streaming.ingest import ingest_evolving_csv, ingest_price_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RUN_STARTED_MS = 1_700_000_000_000
RUN_SIZES = (30, 60, 90)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ---- inputs ---------------------------------------------------------------------------------


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return star.price_ticks(spark, sf)


def silver(spark: SparkSession, sf: str) -> DataFrame:
    return clean.silver(
        ticks(spark, sf), crops=star.CROPS, mandis=star.MANDIS, aliases=star.ALIASES
    )


def gold(spark: SparkSession, sf: str) -> DataFrame:
    return features.gold(silver(spark, sf))


def price_series(spark: SparkSession, sf: str) -> DataFrame:
    return latest.as_series(silver(spark, sf))


def saved_silver(spark: SparkSession, sf: str) -> DataFrame:
    """The silver table written once, for queries that read it several times."""
    path = work_path(spark, "silver")
    tables.write_table(silver(spark, sf), path)
    return tables.read_table(spark, path)


def saved_series(spark: SparkSession, sf: str) -> DataFrame:
    return latest.as_series(saved_silver(spark, sf))


def rain(spark: SparkSession, sf: str) -> DataFrame:
    """The weather signals as a saved table: its size is known when a join with it is planned, so
    the large side need not shuffle by market."""
    path = work_path(spark, "signals")
    rows = signals.weather_signals(star.latest_weather_documents(spark, sf))
    tables.write_table(rows, path)
    return tables.read_table(spark, path)


def text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: signed_round(F.col(c), digits) for c in columns})


# ---- sources and sinks ----------------------------------------------------------------------


def _csv_folder(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> str:
    path = work_path(spark, "csv")
    prices.export_csv(ticks(spark, sf) if rows is None else rows, path)
    return path


@query
def csv_stream_ingest(spark, sf):
    source, target = _csv_folder(spark, sf), work_path(spark, "bronze")
    ingest_price_csv(spark, source, target, work_path(spark, "progress"))
    return tables.read_table(spark, target)


@query
def stream_rerun(spark, sf):
    """Ingest, ingest again without new files, then once more after new files came."""
    source = _csv_folder(spark, sf)
    target, progress = work_path(spark, "bronze"), work_path(spark, "progress")
    counts = work_path(spark, "counts")
    for step in ("first", "again", "more"):
        if step == "more":
            ticks(spark, sf).write.mode("append").option("header", True).csv(source)
        ingest_price_csv(spark, source, target, progress)
        rows = tables.read_table(spark, target).groupBy("mandi").agg(F.count("*").alias("rows"))
        tables.write_table(rows.withColumn("step", F.lit(step)), counts, mode="append")
    return tables.read_table(spark, counts)


@query
def evolving_stream(spark, sf):
    """Files of 7 and of 8 columns in one folder, in batches of three, with a rerun that finds nothing new."""
    rows, source = ticks(spark, sf), work_path(spark, "csv")
    late = F.col("date") >= "1995-01-01"
    columns = [*prices.PRICE_COLUMNS]
    parts = rows.filter(~F.coalesce(late, F.lit(False))).select(*columns), rows.filter(late).select("state", *columns[::-1])
    for part in parts:
        writer = part.write.mode("append").option("header", True)
        for side in ("Leading", "Trailing"):
            writer = writer.option(f"ignore{side}WhiteSpace", False)
        writer.csv(source)
    target, progress = work_path(spark, "bronze"), work_path(spark, "progress")
    for _ in range(2):
        ingest_evolving_csv(spark, source, target, progress, max_files_per_batch=3)
    return tables.read_table(spark, target, merge_schema=True).select(*columns, "state")


@query
def csv_typed_read(spark, sf):
    """Texts among the prices: they become NULL and the row stays."""
    broken = ticks(spark, sf).withColumn(
        "max_price",
        F.when(F.col("arrivals_tonnes") >= 40, F.lit("n/a")).otherwise(
            F.col("max_price").cast("string")
        ),
    )
    return prices.read_price_csv(spark, _csv_folder(spark, sf, broken), extra=["state"])


@query
def csv_export(spark, sf):
    path = work_path(spark, "export")
    prices.export_csv(text(silver(spark, sf), "date"), path)
    return prices.read_price_csv(spark, path)


@query
def evolving_append(spark, sf):
    path = work_path(spark, "evolving")
    rows = silver(spark, sf)
    tables.append_evolving(rows.drop("state"), path)
    tables.append_evolving(rows, path)
    merged = tables.read_table(spark, path, merge_schema=True)
    return merged.groupBy("crop", "state").agg(
        F.count("*").alias("rows"), F.count("state").alias("with_state")
    )


@query
def partitioned_overwrite(spark, sf):
    path = work_path(spark, "silver")
    rows = silver(spark, sf)
    tables.write_table(rows.drop("state"), path, partition_cols=SERIES)
    tables.write_table(rows, path, partition_cols=SERIES)
    return text(tables.read_table(spark, path), "date")


@query
def filtered_table_read(spark, sf):
    path = work_path(spark, "silver")
    tables.write_table(silver(spark, sf), path, partition_cols=SERIES)
    return text(
        tables.read_table(spark, path, "crop = 'Onion' AND modal_price >= 50000"), "date"
    )


@query
def namespace_table(spark, sf):
    name = "marketboard_check"
    path = work_path(spark, name)
    tables.ensure_namespace(spark, name, path)
    tables.ensure_namespace(spark, name, path)
    table = f"{name}.coverage_{path.rsplit('-', 1)[1]}"
    tables.write_table(audit.rows_per_series(ticks(spark, sf)), table)
    tables.write_table(audit.rows_per_series(ticks(spark, sf)), table, mode="append")
    return tables.read_table(spark, table)


@query
def bronze_batch_load(spark, sf):
    path = work_path(spark, "bronze")
    prices.load_prices(ticks(spark, sf).drop("state"), path)
    prices.load_prices(ticks(spark, sf), path)
    return tables.read_table(spark, path)


@query
def json_price_records(spark, sf):
    """Service replies with two records each, one of them with texts for numbers."""
    number = {
        f: F.col(c).cast("string")
        for f, c in prices.RECORD_FIELDS.items()
        if c in prices.NUMBER_COLUMNS
    }
    plain = {f: F.col(c) for f, c in prices.RECORD_FIELDS.items() if f not in number}

    def record(**changed):
        merged = {**plain, **number, **changed}
        return F.struct(*[merged[f].alias(f) for f in prices.RECORD_FIELDS])

    replies = ticks(spark, sf).select(
        F.array(
            record(),
            record(Max_x0020_Price=F.lit("NR"), Min_x0020_Price=F.lit(None).cast("string")),
        ).alias("records")
    )
    path = work_path(spark, "replies")
    # Names of fields and half of the values repeat, so compressed replies are a small part of the plain ones.
    replies.write.option("compression", "gzip").json(path)
    return prices.read_price_json(spark, path)


def _dimensions(spark, sf) -> dimensions.Dimensions:
    part = star.table(spark, sf, "part")
    supplier = star.table(spark, sf, "supplier")
    nation = star.table(spark, sf, "nation")
    crop = F.struct(
        F.split("p_name", " ").alias("aliases"),
        F.array(F.pmod("p_size", F.lit(12)) + 1).alias("harvest_months"),
        F.col("p_size").alias("shelf_life_days"),
        F.col("p_type").alias("rain_sensitivity"),
    )
    name = F.concat(F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"))
    crops = part.select(F.create_map(name, crop).alias("crops"))
    mandi = F.struct(
        F.col("n_name").alias("state"),
        (F.col("s_acctbal") / 128).alias("lat"),
        (F.col("s_acctbal") / 64).alias("lon"),
        F.concat(F.lit("MH-"), F.col("s_suppkey").cast("string")).alias("apmc_code"),
    )
    mandis = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.create_map("s_name", mandi).alias("mandis")
    )
    path = work_path(spark, "dimensions")
    outlook.concat_all([crops, mandis]).write.json(path)
    return dimensions.dimensions(dimensions.read_dimensions(spark, path, multi_line=False))


@query
def dimension_mandis(spark, sf):
    return _dimensions(spark, sf).mandis


@query
def dimension_crops(spark, sf):
    rows = _dimensions(spark, sf).crops
    return rows.withColumns({c: F.array_join(c, ",") for c in ("aliases", "harvest_months")})


@query
def dimension_aliases(spark, sf):
    return _dimensions(spark, sf).aliases


# ---- projections and filters ------------------------------------------------------------------


@query
def crop_names(spark, sf):
    rows = ticks(spark, sf).select(
        F.col("crop").alias("raw"), canonical_name(F.col("crop"), star.ALIASES).alias("crop")
    )
    return rows.groupBy("raw", "crop").agg(F.count("*").alias("rows"))


@query
def crop_names_by_table(spark, sf):
    """Brand names as aliases of the size of a part, from the part table itself."""
    part = star.table(spark, sf, "part")
    aliases = part.groupBy(F.col("p_name").alias("alias")).agg(F.min("p_brand").alias("name"))
    rows = part.select(F.upper("p_name").alias("crop"))
    named = clean.normalise_crops_by_table(rows, aliases)
    return named.groupBy("crop").agg(F.count("*").alias("rows"))


@query
def parsed_dates(spark, sf):
    rows = clean.typed_dates(ticks(spark, sf))
    return text(rows.groupBy("date").agg(F.count("*").alias("rows")), "date")


@query
def parsed_dates_two_formats(spark, sf):
    rows = clean.typed_dates(ticks(spark, sf), formats=("yyyy-MM-dd", "dd/MM/yyyy"))
    return text(rows.groupBy("date").agg(F.count("*").alias("rows")), "date")


@query
def complete_rows(spark, sf):
    return audit.rows_per_series(clean.complete_rows(clean.typed_dates(ticks(spark, sf))))


@query
def target_rows(spark, sf):
    named = clean.normalise_crops(ticks(spark, sf), star.ALIASES)
    return audit.rows_per_series(
        clean.keep_targets(named, ["Onion", "Tomato"], ["ASIA", "EUROPE", "Africa"])
    )


@query
def target_rows_by_table(spark, sf):
    """Series whose market has a supplier with a high balance."""
    supplier = star.table(spark, sf, "supplier").filter(F.col("s_acctbal") > 9000)
    targets = ticks(spark, sf).select(*SERIES).distinct().join(
        supplier.join(
            star.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
        )
        .join(star.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("r_name").alias("mandi")),
        "mandi", "left_semi",
    )
    return audit.rows_per_series(clean.keep_targets_by_table(ticks(spark, sf), targets))


@query
def positive_prices(spark, sf):
    return audit.rows_per_series(clean.positive_prices(ticks(spark, sf)))


@query
def clean_rows(spark, sf):
    rows = clean.clean(
        ticks(spark, sf), crops=star.CROPS, mandis=star.MANDIS, aliases=star.ALIASES
    )
    return text(rows, "date")


@query
def gold_features(spark, sf):
    return text(gold(spark, sf), "date")


@query
def series_point(spark, sf):
    return text(latest.point(gold(spark, sf), "Onion", "ASIA"), "date")


@query
def series_view(spark, sf):
    return text(price_series(spark, sf), "ds")


@query
def lookup_defaults(spark, sf):
    """Nation of each customer if its name is in a table of the nations that have suppliers."""
    customers = star.table(spark, sf, "customer").withColumnRenamed("c_nationkey", "key")
    have = star.table(spark, sf, "supplier").select("s_nationkey").distinct()
    table = (
        star.table(spark, sf, "nation")
        .join(have, F.col("n_nationkey") == F.col("s_nationkey"))
        .select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("nation"))
    )
    found = signals.lookup_or_default(
        customers.select("c_custkey", "key"), table, "key", {"nation": "NO SUPPLIER"}
    )
    return found.select("c_custkey", "nation")


# ---- counts and profiles ------------------------------------------------------------------------


@query
def rows_per_series(spark, sf):
    return audit.rows_per_series(ticks(spark, sf))


@query
def coverage(spark, sf):
    return text(audit.coverage(silver(spark, sf)), "from_date", "to_date")


@query
def trend_distribution(spark, sf):
    return features.trend_distribution(gold(spark, sf))


@query
def chunks_per_document(spark, sf):
    return audit.chunks_per_document(
        chunks.document_chunks(star.advisory_documents(spark, sf)).select(
            "crop", "source_doc", F.explode("chunks")
        )
    )


@query
def value_profile(spark, sf):
    return audit.value_profile(ticks(spark, sf))


@query
def stage_counts(spark, sf):
    return audit.stage_counts(
        ticks(spark, sf), crops=star.CROPS, mandis=star.MANDIS, aliases=star.ALIASES
    )


# ---- windows --------------------------------------------------------------------------------


@query
def silver_rows(spark, sf):
    return text(silver(spark, sf), "date")


@query
def rolling_means(spark, sf):
    rows = silver(spark, sf).withColumns(
        {f"mean_{n}": features.trailing_mean(n) for n in (7, 30)}
    )
    return text(rows.select(*SERIES, "date", "mean_7", "mean_30"), "date")


@query
def train_test_split(spark, sf):
    rows = series.split_label(price_series(spark, sf))
    return text(
        rows.groupBy(*SERIES, "part").agg(
            F.count("*").alias("rows"), F.min("ds").alias("first"), F.max("ds").alias("last")
        ),
        "first", "last",
    )


@query
def long_series(spark, sf):
    """Series with enough rows, at a limit that some of them miss."""
    kept = series.long_enough(price_series(spark, sf), 1300)
    return audit.rows_per_series(kept)


# ---- latest and top-k -----------------------------------------------------------------------


@query
def latest_per_series(spark, sf):
    return text(latest.latest_per_series(gold(spark, sf)), "date")


@query
def latest_table_date(spark, sf):
    return text(latest.at_table_date(silver(spark, sf), star.CROPS, star.MANDIS), "date")


@query
def latest_by_crop(spark, sf):
    rows = latest.at_crop_date(silver(spark, sf), ["ASIA", "EUROPE", "AMERICA"])
    return text(rows.select("crop", "mandi", "date", "modal_price"), "date")


@query
def price_board(spark, sf):
    rows = latest.price_board(latest.at_crop_date(silver(spark, sf)))
    return rows.select("crop", F.to_json("prices").alias("prices"))


@query
def price_board_map(spark, sf):
    rows = latest.price_board_map(latest.at_table_date(silver(spark, sf)))
    return rows.select(F.to_json("board").alias("board"))


@query
def last_prices(spark, sf):
    rows = latest.tail_of_series(silver(spark, sf), 10)
    return text(rows.select(*SERIES, "date", "modal_price", "pos"), "date")


@query
def newest_rows(spark, sf):
    return text(latest.newest_rows(gold(spark, sf)), "date")


@query
def result_preview(spark, sf):
    rows = text(clean.typed_dates(ticks(spark, sf)), "date")
    grouped = rows.groupBy("date", "mandi").agg(F.count("*").alias("ticks"))
    return outlook.preview(grouped, ["mandi", "date"])


# ---- union ------------------------------------------------------------------------------------


@query
def union_extracts(spark, sf):
    """Silver put together again from one extract per crop, one of them without the state."""
    rows = silver(spark, sf)
    parts = [rows.filter(F.col("crop") == c) for c in star.CROPS]
    return text(outlook.concat_all([*parts[:-1], parts[-1].drop("state")]), "date")


# ---- weather and verdicts -----------------------------------------------------------------------


@query
def rain_totals(spark, sf):
    rows = star.weather_documents(spark, sf)
    return text(
        rows.select("mandi", "period", signals.rain_total(F.col("document")).alias("mm")),
        "period",
    )


@query
def weather_signals(spark, sf):
    return text(signals.weather_signals(star.weather_documents(spark, sf)), "period")


def _some_rain(spark, sf):
    """Signals of the markets that were wet in the last period; the others have no data."""
    return rain(spark, sf).filter(F.col("mandi") > "B")


@query
def weather_defaults(spark, sf):
    rows = latest.latest_per_series(gold(spark, sf)).select(*SERIES, "trend")
    return signals.with_weather(rows, _some_rain(spark, sf))


@query
def rule_lookup(spark, sf):
    rows = signals.with_weather(gold(spark, sf), rain(spark, sf))
    return (
        signals.decide(rows)
        .groupBy("trend", "signal", "decision", "confidence")
        .agg(F.count("*").alias("rows"))
    )


@query
def verdicts(spark, sf):
    flat = signals.verdicts(latest.latest_per_series(gold(spark, sf)), rain(spark, sf))
    return signals.as_verdict_structs(flat).select(
        "decision", "confidence", "reason_en",
        *[F.col(f"price_trend.{c}").alias(c) for c in ("crop", "mandi", "date", "trend")],
        F.col("price_trend.pct_change_7d").alias("pct_change_7d"),
        F.col("weather.rain_3d_mm").alias("rain_3d_mm"),
        F.col("weather.description").alias("description"),
    )


@query
def verdicts_all_days(spark, sf):
    """Every day of every series against the last weather of its market."""
    rows = signals.verdicts(gold(spark, sf), rain(spark, sf))
    return text(rows.select(*SERIES, "date", "decision", "confidence", "reason_en"), "date")


@query
def trend_verdicts(spark, sf):
    rows = signals.trend_verdicts(gold(spark, sf))
    return text(rows.select(*SERIES, "date", "decision", "confidence", "reason_en"), "date")


# ---- forecasts ----------------------------------------------------------------------------------


def _models(spark, sf):
    return forecast.train(price_series(spark, sf))


@query
def fitted_models(spark, sf):
    rows = rounded(_models(spark, sf), 4, "intercept", "slope", "sigma")
    factors = F.map_entries("weekday_factors")
    told = F.transform(
        factors,
        lambda e: F.format_string("%d:%.4f", e["key"], F.round(e["value"], 4)),
    )
    return text(
        rows.select(
            *SERIES, "origin", "last_train", "n_train", "intercept", "slope", "sigma",
            F.array_join(told, " ").alias("weekday_factors"),
        ),
        "origin", "last_train",
    )


def _forecast_rows(df):
    return text(rounded(df, 2, "yhat", "yhat_lower", "yhat_upper"), "ds")


@query
def forecast_bands(spark, sf):
    return _forecast_rows(forecast.forecast(_models(spark, sf)))


@query
def forecast_tail(spark, sf):
    rows = forecast.last_periods(forecast.forecast(_models(spark, sf), 30), 7)
    return _forecast_rows(rows.drop("pos"))


@query
def future_dates(spark, sf):
    ends = silver(spark, sf).groupBy(*SERIES).agg(F.max("date").alias("last"))
    from marketboard.functions.dates import days_after

    days = ends.select(*SERIES, F.explode(days_after(F.col("last"), F.lit(10))).alias("ds"))
    return text(days, "ds")


@query
def holdout_metrics(spark, sf):
    rows = saved_series(spark, sf)
    return forecast.evaluate(rows, forecast.train(rows))


@query
def paired_by_position(spark, sf):
    rows = saved_series(spark, sf)
    pairs = series.pair_by_position(
        series.test_part(rows), forecast.forecast(forecast.train(rows), 45)
    )
    shown = rounded(pairs, 2, "yhat")
    return text(shown.select(*SERIES, "pos", "ds", "forecast_ds", "y", "yhat"), "ds", "forecast_ds")


@query
def paired_by_date(spark, sf):
    rows = saved_series(spark, sf)
    pairs = series.pair_by_date(
        series.test_part(rows), forecast.forecast(forecast.train(rows), 45)
    )
    shown = rounded(pairs, 2, "yhat")
    return text(shown.select(*SERIES, "ds", "y", "yhat"), "ds")


@query
def backtest_detail(spark, sf):
    rows = saved_series(spark, sf)
    return text(forecast.backtest(rows, forecast.train(rows)), "date")


@query
def backtest_summary(spark, sf):
    rows = saved_series(spark, sf)
    return forecast.backtest_summary(forecast.backtest(rows, forecast.train(rows)))


def _runs(rows: DataFrame) -> DataFrame:
    """Runs of three training sizes over all series."""
    each = [
        runs.ledger(
            forecast.evaluate(rows, forecast.train(rows, n), n),
            {"train_days": n, "seasonality_mode": "multiplicative"},
            RUN_STARTED_MS + n, RUN_STARTED_MS + n + 1, "models/",
        )
        for n in RUN_SIZES
    ]
    return outlook.concat_all(each)


@query
def run_ledger(spark, sf):
    return _runs(saved_series(spark, sf)).select(
        "run_id", "run_name", *SERIES, "start_time", "end_time", "status",
        F.col("params")["train_days"].alias("train_days"),
        F.col("params")["crop"].alias("param_crop"),
        F.col("metrics")["MAPE"].alias("mape"),
        F.col("metrics")["MAE"].alias("mae"),
        F.col("tags")["model_path"].alias("model_path"),
    )


@query
def ranked_runs(spark, sf):
    return runs.ranked_runs(runs.run_summary(_runs(saved_series(spark, sf))), good_below=60.0)


@query
def best_run(spark, sf):
    return runs.best_run(runs.run_summary(_runs(saved_series(spark, sf))))


@query
def best_run_per_series(spark, sf):
    return runs.best_run_per_series(runs.run_summary(_runs(saved_series(spark, sf))))


@query
def models_of_best_runs(spark, sf):
    """Model rows saved with their run id, read back, and only those of the best runs kept."""
    path, kept = work_path(spark, "models"), work_path(spark, "runs")
    rows = saved_series(spark, sf)
    tables.write_table(_runs(rows), kept)
    ledger = tables.read_table(spark, kept)
    for n in RUN_SIZES:
        ids = ledger.filter(F.col("start_time") == RUN_STARTED_MS + n).select(*SERIES, "run_id")
        fits = forecast.train(rows, n).join(ids, SERIES)
        tables.write_table(fits, path, mode="append")
    best = runs.best_run_per_series(runs.run_summary(ledger))
    chosen = runs.models_of_runs(tables.read_table(spark, path), best)
    ahead = forecast.forecast(chosen, 5)
    return _forecast_rows(ahead)


@query
def price_outlook(spark, sf):
    daily = saved_silver(spark, sf)
    models = forecast.train(latest.as_series(daily), None)
    rows = outlook.outlook(daily, forecast.forecast(models))
    return text(rounded(rows, 2, "price", "yhat_lower", "yhat_upper"), "date")


# ---- texts --------------------------------------------------------------------------------------


def _texts(spark, sf):
    return star.spread_table(spark, sf, "documents", ["doc_id", "text"])


@query
def text_chunks(spark, sf):
    return chunks.text_chunks(_texts(spark, sf))


@query
def text_chunks_all(spark, sf):
    """Every chunk, however short."""
    return chunks.text_chunks(_texts(spark, sf), size=120, overlap=30, min_chars=None)


def _passages(spark, sf):
    """A stored table of chunk rows: number, id, crop, source_doc, page, text."""
    return chunks.numbered_chunks(star.advisory_documents(spark, sf)).withColumnRenamed("chunk_id", "id")


@query
def chunk_table(spark, sf):
    return chunks.chunk_table(star.advisory_documents(spark, sf))


@query
def first_passages(spark, sf):
    rows = retrieval.first_passages(_passages(spark, sf), top_k=3, order="number")
    return rows.select("crop_key", "rank", "id", "source_doc", "page", "text")


@query
def first_passages_any(spark, sf):
    rows = retrieval.first_passages_any(_passages(spark, sf), top_k=10, order="number")
    return rows.select("rank", "id", "source_doc", "page", "text")


@query
def context_blocks(spark, sf):
    return retrieval.context_blocks(
        retrieval.first_passages(_passages(spark, sf), top_k=3, order="number"), ["crop_key"]
    )


def _advised(spark, sf):
    """Flat verdicts of every day with the template answer."""
    return advice.with_recommendation(signals.verdicts(gold(spark, sf), rain(spark, sf)))


@query
def recommendations(spark, sf):
    return text(_advised(spark, sf).select(*SERIES, "date", "recommendation"), "date")


@query
def prompts(spark, sf):
    blocks = retrieval.context_blocks(
        retrieval.first_passages(_passages(spark, sf), order="number"), ["crop_key"]
    )
    flat = signals.verdicts(latest.latest_per_series(gold(spark, sf)), rain(spark, sf))
    joined = flat.withColumn("crop_key", F.lower("crop")).join(blocks, "crop_key", "left")
    return advice.with_prompts(joined).select(*SERIES, "system_prompt", "user_prompt")


@query
def masked_texts(spark, sf):
    rows = advice.with_mask(_advised(spark, sf), "recommendation")
    told = F.transform("mask.found", lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return text(
        rows.select(
            *SERIES, "date", F.col("mask.masked").alias("masked"),
            F.array_join(told, ",").alias("placeholders"),
        ),
        "date",
    )


@query
def restored_texts(spark, sf):
    """Whole documents masked on common words and restored."""
    terms = ["the", "que", "und", "los"]
    rows = advice.with_mask(_texts(spark, sf), "text", terms)
    masked, present = F.col("mask.masked"), F.map_from_entries("mask.found")
    return rows.select(
        "doc_id",
        F.md5(masked).alias("masked_digest"),
        F.md5(restore_terms(masked, terms, present)).alias("restored_digest"),
    )


@query
def speech_texts(spark, sf):
    """What a speech service with its own limit of 500 characters would take."""
    return _texts(spark, sf).select("doc_id", speech_text(F.col("text"), 500).alias("speech"))


@query
def language_routing(spark, sf):
    rows = _advised(spark, sf).select(*SERIES, "date", F.col("recommendation").alias("text"))
    wanted = advice.in_languages(advice.with_mask(rows), [*LANGUAGE_CODES, "Swahili"])
    routed = advice.route_language(wanted)
    return (
        routed.groupBy("language", "language_code", "needs_translation", *SERIES)
        .agg(
            F.count("*").alias("rows"),
            F.sum(
                F.conv(F.substring(F.md5("source_text"), 1, 8), 16, 10).cast("bigint")
            ).alias("digest"),
            F.sum(F.coalesce(F.size(F.map_keys("placeholders")), F.lit(0))).alias("placeholders"),
        )
        .withColumn("needs_translation", F.col("needs_translation").cast("int"))
    )


# ---- vectors ------------------------------------------------------------------------------------


def _vectors(spark, sf):
    return star.labelled_vectors(spark, sf)


def _centroid_queries(spark, sf):
    """One query per label: the mean direction of its vectors."""
    rows = vectors.centroids(_vectors(spark, sf), "crop")
    return rows.select(
        F.regexp_extract("crop", r"\d+", 0).cast("bigint").alias("query_id"), "embedding", "crop"
    )


@query
def vector_topk(spark, sf):
    return vectors.nearest(_centroid_queries(spark, sf), _vectors(spark, sf), 10)


@query
def vector_topk_cells(spark, sf):
    """The same search with both sides cut into cells."""
    return vectors.nearest(
        _centroid_queries(spark, sf), _vectors(spark, sf), 10, max_shipped=0, cell_rows=400
    )


@query
def retrieve_postfilter(spark, sf):
    rows = retrieval.retrieve(_centroid_queries(spark, sf), _vectors(spark, sf), top_k=4)
    return rows.select("query_id", "rank", "id", "crop", "score")


@query
def retrieve_prefilter(spark, sf):
    rows = retrieval.retrieve(
        _centroid_queries(spark, sf), _vectors(spark, sf), top_k=4, prefilter=True
    )
    return rows.select("query_id", "rank", "id", "crop", "score")


@query
def vector_table(spark, sf):
    """Vectors saved with their fields and read back."""
    path = work_path(spark, "vectors")
    tables.write_table(_vectors(spark, sf), path)
    rows = tables.read_table(spark, path)
    return rows.select(
        "id", "crop", F.size("embedding").alias("dim"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double")), 4).alias(
            "total"
        ),
    )


def _make_letter_encoder():
    """A small hashing encoder: words by the first hexadecimal digit of their digest, which SQL can tell as well."""
    import hashlib
    import re

    def encode(texts):
        counts = []
        for one in texts:
            row = [0.0] * 16
            for word in re.findall("[A-Za-z0-9]+", one):
                row[int(hashlib.md5(word.encode()).hexdigest()[0], 16)] += 1
            counts.append(row)
        return counts

    return encode


@query
def plugged_embeddings(spark, sf):
    """Whole documents by a plugged-in encoder, as (doc_id, dim, weight) rows without the zeros."""
    encoded = vectors.encode_with(_texts(spark, sf), _make_letter_encoder, model="first digits")
    cells = chunks.exploded(encoded.select("doc_id", "embedding"), "embedding", "dim", "weight")
    cells = cells.filter("weight > 0")
    return cells.select("doc_id", "dim", F.round(F.col("weight").cast("double"), 4).alias("weight"))


@query
def text_embeddings(spark, sf):
    """Unit vectors of whole documents as (doc_id, dim, weight) rows without the zeros."""
    texts = _texts(spark, sf)
    encoded = vectors.encode(texts, vectors.fit_encoder(texts, size=64))
    cells = chunks.exploded(encoded.select("doc_id", "embedding"), "embedding", "dim", "weight")
    return cells.filter(F.col("weight") != 0).select(
        "doc_id", "dim", F.round(F.col("weight").cast("double"), 4).alias("weight")
    )


# ---- compositions -------------------------------------------------------------------------------


@query
def verdict_passages(spark, sf):
    passages = board.crop_passages(retrieval.first_passages(_passages(spark, sf), order="number"))
    flat = signals.verdicts(latest.latest_per_series(gold(spark, sf)), rain(spark, sf))
    joined = flat.withColumn("crop_key", F.lower("crop")).join(passages, "crop_key", "left")
    return joined.select(*SERIES, "decision", "advisory_text", "advisory_source")


@query
def advisory_board(spark, sf):
    rows = board.advisory_board(
        gold(spark, sf), rain(spark, sf), retrieval.first_passages(_passages(spark, sf), order="number"),
        languages=["English", "Hindi", "Tamil"],
    )
    return rows.withColumn("all_prices", F.to_json("all_prices")).drop("sources", "placeholders", "texts", "translated")


def _questions(daily):
    """One question for each crop of the prices."""
    return daily.select("crop").distinct().select(
        F.xxhash64("crop").alias("query_id"), "crop",
        F.concat(F.col("crop"), F.lit(" storage harvest price")).alias("text"),
    )


@query
def advisory_board_scored(spark, sf):
    """The board with passages found by text vectors, and the outlook nested in each row."""
    target = work_path(spark, "vectors")
    store.save_store(chunks.numbered_chunks(star.advisory_documents(spark, sf)), target)
    daily = saved_silver(spark, sf)
    found = store.search(store.open_store(spark, target), _questions(daily))
    keyed = found.withColumn("crop_key", F.lower("crop"))
    view = outlook.outlook(
        daily, forecast.forecast(forecast.train(latest.as_series(daily), None))
    )
    terms = ["the", "₹", "quintal", "und", "que"]

    def make_translator():
        """Stands for a service: it changes a word, and for one language it is down."""

        def translate(texts, code):
            if code == "ta-IN":
                raise ConnectionError(code)
            return [f"{code}: {t.replace('price', 'Preis')}" for t in texts]

        return translate

    rows = board.advisory_board(
        features.gold(daily), rain(spark, sf), keyed, languages=["English", "Hindi", "Tamil"], outlook=view,
        terms=terms, make_translator=make_translator,
    )

    def told(column):
        pairs = F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
        return F.array_join(pairs, ",")

    points = F.transform("outlook", lambda p: F.concat_ws(" ", p["date"].cast("string"), p["kind"], F.round(p["price"]).cast("bigint")))
    shown = {
        f"{name}_{kind}": F.col(kind)[t] if kind != "placeholders" else told(F.col(kind)[t])
        for t, name in (("recommendation", "advice"), ("advisory_text", "passage"))
        for kind in ("sources", "placeholders", "texts")
    }
    return rows.select(
        *SERIES, "language", "decision", "weather", "advisory_source", *[c.alias(n) for n, c in shown.items()],
        F.col("translated")["advisory_text"].cast("int").alias("passage_translated"),
        F.array_join(points, "; ").alias("outlook"),
    )


def _stages(spark, sf, root, source=None, **options):
    return medallion.run_stages(
        spark, source or _csv_folder(spark, sf), star.advisory_documents(spark, sf),
        root, star.CROPS, star.MANDIS, star.ALIASES, **options,
    )


@query
def medallion_stages(spark, sf):
    """All stages from files to vectors: the rows that each one wrote."""
    reports = _stages(spark, sf, work_path(spark, "tables"))
    return medallion.stage_table(spark, reports).select("stage", "rows")


@query
def medallion_resumed(spark, sf):
    """A run that ended after its fourth stage goes on at the fifth: the error of each series' selected run."""
    root, source = work_path(spark, "tables"), _csv_folder(spark, sf)
    first = _stages(spark, sf, root, source, until="models")
    then = _stages(spark, sf, root, source)
    kept = [r.stage for r in then if r in first]
    best = tables.read_table(spark, f"{root}/best_runs").select(*SERIES, F.col("mape").alias("selected_mape"))
    found = tables.read_table(spark, f"{root}/backtest_summary").join(best, SERIES)
    return found.withColumns({"kept": F.lit(" ".join(kept)), "entries": F.lit(len(medallion.finished_stages(spark, root)))})


@query
def stored_search(spark, sf):
    """Questions against the vectors that a run of all stages has left, opened by the place of the table."""
    root = work_path(spark, "tables")
    _stages(spark, sf, root)
    opened = store.open_store(spark, f"{root}/vectors")
    asked = _questions(tables.read_table(spark, f"{root}/silver"))
    rows = store.search(opened, asked, top_k=3, prefilter=True).join(asked.select("query_id", F.col("crop").alias("asked")), "query_id")
    return rounded(rows, 4, "score").select("asked", "rank", "chunk_id", "id", "source_doc", "page", "score", "text")


@query
def chunk_numbers(spark, sf):
    """Numbers of chunks whose documents have text keys, of which some are missing and many repeat."""
    rows = star.advisory_documents(spark, sf)
    name = F.concat(F.lit("doc-"), (F.col("doc_id") % 97).cast("string"))
    keyed = rows.withColumn("doc_id", F.when(F.col("doc_id") % 7 > 0, name))
    found = chunks.numbered_chunks(keyed, size=80, overlap=20, min_chars=None)
    return found.select("number", "chunk_id", "doc_id", "page", F.md5("text").alias("digest"))
