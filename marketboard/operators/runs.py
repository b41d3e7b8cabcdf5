"""Run ledger and the choice of the best run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketboard.config import GOOD_MAPE_PCT, SERIES


def ledger(
    metrics: DataFrame,
    params: Mapping[str, object],
    started_ms: int,
    ended_ms: int,
    model_location: str = "",
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """One finished run per series, with its parameters and metrics as maps.

    The run id is a digest of series, parameters and start time: running the same training twice
    gives two ids, recomputing a lost task gives the same one.
    """
    texts = {k: str(v) for k, v in params.items()}
    settings = [x for k, v in sorted(texts.items()) for x in (F.lit(k), F.lit(v))]
    stamp = "|".join(f"{k}={v}" for k, v in sorted(texts.items())) + f"|{started_ms}"
    own = [x for k in keys for x in (F.lit(k), F.col(k))]
    return metrics.select(
        F.md5(F.concat_ws("|", *keys, F.lit(stamp))).alias("run_id"),
        F.concat_ws("_", *keys).alias("run_name"),
        *keys,
        F.create_map(*own, *settings).alias("params"),
        F.create_map(F.lit("MAPE"), F.col("mape"), F.lit("MAE"), F.col("mae")).alias("metrics"),
        F.lit(started_ms).cast("bigint").alias("start_time"),
        F.lit(ended_ms).cast("bigint").alias("end_time"),
        F.lit("FINISHED").alias("status"),
        F.create_map(
            F.lit("model_path"), F.concat(F.lit(model_location), F.concat_ws("_", *keys))
        ).alias("tags"),
    )


def run_summary(runs: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    return runs.select(
        *keys,
        F.col("metrics")["MAPE"].alias("mape"),
        F.col("metrics")["MAE"].alias("mae"),
        "run_id",
        F.col("tags")["model_path"].alias("model_path"),
    )


def ranked_runs(summary: DataFrame, good_below: float = GOOD_MAPE_PCT) -> DataFrame:
    """Runs by ascending MAPE with a quality flag."""
    flagged = summary.withColumn(
        "flag", F.when(F.col("mape") < good_below, "GOOD").otherwise("CHECK")
    )
    return flagged.orderBy("mape", "run_id")


def best_run(summary: DataFrame) -> DataFrame:
    """The run with the lowest MAPE of all."""
    return summary.orderBy("mape", "run_id").limit(1)


def best_run_per_series(summary: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """The run with the lowest MAPE of each series; equal errors are settled by run id."""
    others = [c for c in summary.columns if c not in (*keys, "mape", "run_id")]
    best = F.min(F.struct("mape", "run_id", *others)).alias("_best")
    picked = summary.groupBy(*keys).agg(best)
    return picked.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in ("mape", "run_id", *others)])


def models_of_runs(models: DataFrame, runs: DataFrame) -> DataFrame:
    """Model rows of the chosen runs."""
    return models.join(runs.select("run_id"), "run_id", "left_semi")
