"""All stages in order, from raw files to vectors, each written as a table."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marketboard.config import CROP_ALIASES, SERIES, TRAIN_ROWS
from marketboard.operators.chunks import numbered_chunks
from marketboard.operators.clean import silver
from marketboard.operators.features import gold
from marketboard.operators.forecast import backtest, backtest_summary, evaluate, train
from marketboard.operators.latest import as_series
from marketboard.operators.runs import best_run_per_series, ledger, models_of_runs, run_summary
from marketboard.operators.store import save_store
from marketboard.sources.tables import read_table, write_table
from marketboard.streaming.ingest import ingest_price_csv


STAGES = ("bronze", "silver", "gold", "models", "best_runs", "backtest", "chunks", "vectors")


@dataclass
class StageReport:
    stage: str
    rows: int
    seconds: float
    run: int = 0


MANIFEST = "run bigint, stage string, rows bigint, seconds double"


def finished_stages(spark: SparkSession, root: str) -> list[StageReport]:
    """The stages that all runs on this root have committed, by run and in their order."""
    place = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    # an empty append, so that there is something to read before the first stage
    spark.createDataFrame([], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/_manifest")
    rows = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest").orderBy("run", place).collect()
    return [StageReport(r["stage"], r["rows"], r["seconds"], r["run"]) for r in rows]


def _commit(spark: SparkSession, root: str, report: StageReport) -> None:
    """One row in the manifest, written when all that the stage writes is there."""
    row = (report.run, report.stage, report.rows, report.seconds)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/_manifest")


def save_counted(
    df: DataFrame, target: str, partition_cols: Sequence[str] = (), mode: str = "overwrite"
) -> int:
    """Write a table and return its row count, taken while it is written."""
    seen = Observation()
    write_table(df.observe(seen, F.count(F.lit(1)).alias("rows")), target, mode, partition_cols)
    return seen.get["rows"]


def run_stages(
    spark: SparkSession,
    source_csv: str,
    documents: DataFrame,
    root: str,
    crops: Sequence[str] | None = None,
    mandis: Sequence[str] | None = None,
    aliases: Mapping[str, str] = CROP_ALIASES,
    train_rows: int = TRAIN_ROWS,
    until: str | None = None,
) -> list[StageReport]:
    """Ingest, clean, features, training, selection, back-test of the selected runs, chunks, vectors.

    Tables lie under `root`, which must be a folder that all executors reach. Each stage reads the tables of those before
    it and is entered in the manifest when its own are written. A call goes on with the last run on this root if that has
    not finished (it failed, or ended after the stage `until`): committed stages are reported and not repeated, and a stage
    that failed half way replaces what it had written. Otherwise a new run begins, which adds its models and its entries in
    the run ledger to those of the runs before. The files that a run takes in are those there when its first stage runs.
    """
    before = finished_stages(spark, root)
    run = max((r.run for r in before), default=0)
    done = {r.stage: r for r in before if r.run == run}
    if not done or len(done) == len(STAGES):
        run, done = max(int(time.time() * 1000), run + 1), {}

    def table(name: str) -> DataFrame:
        return read_table(spark, f"{root}/{name}")

    def bronze_stage() -> int:
        ingest_price_csv(spark, source_csv, f"{root}/bronze", f"{root}/_checkpoints/bronze")
        return table("bronze").count()

    def silver_stage() -> int:
        rows = silver(table("bronze"), crops=crops, mandis=mandis, aliases=aliases)
        return save_counted(rows, f"{root}/silver", SERIES)

    def gold_stage() -> int:
        return save_counted(gold(table("silver")), f"{root}/gold", SERIES)

    def models_stage() -> int:
        """A run's fits and ledger lie in folders of their own, so that a repeated stage adds nothing twice."""
        series = as_series(table("gold"))
        rows = save_counted(train(series, train_rows), f"{root}/fits")
        entries = ledger(
            evaluate(series, table("fits"), train_rows),
            {"train_days": train_rows, "seasonality_mode": "multiplicative"},
            run, max(int(time.time() * 1000), run), f"{root}/models/",
        )
        write_table(entries, f"{root}/runs/started={run}")
        ids = read_table(spark, f"{root}/runs/started={run}").select(*SERIES, "run_id")
        write_table(table("fits").join(ids, SERIES), f"{root}/models/started={run}")
        return rows

    def select_stage() -> int:
        return save_counted(best_run_per_series(run_summary(table("runs"))), f"{root}/best_runs")

    def backtest_stage() -> int:
        chosen = models_of_runs(table("models"), table("best_runs"))
        rows = save_counted(backtest(as_series(table("gold")), chosen, None), f"{root}/backtest")
        write_table(backtest_summary(table("backtest")), f"{root}/backtest_summary")
        return rows

    def chunk_stage() -> int:
        return save_counted(numbered_chunks(documents), f"{root}/chunks")

    def vector_stage() -> int:
        return save_store(table("chunks"), f"{root}/vectors", f"{root}/encoders")

    work: dict[str, Callable[[], int]] = dict(
        zip(
            STAGES,
            (bronze_stage, silver_stage, gold_stage, models_stage, select_stage, backtest_stage, chunk_stage, vector_stage),
            strict=True,
        )
    )
    reports = []
    for name in STAGES[: STAGES.index(until) + 1] if until else STAGES:
        if name not in done:
            begun = time.monotonic()
            rows = work[name]()
            done[name] = StageReport(name, rows, time.monotonic() - begun, run)
            _commit(spark, root, done[name])
        reports.append(done[name])
    return reports


def stage_table(spark: SparkSession, reports: list[StageReport]) -> DataFrame:
    return spark.createDataFrame(
        [(r.stage, r.rows, r.seconds) for r in reports],
        "stage string, rows bigint, seconds double",
    )
