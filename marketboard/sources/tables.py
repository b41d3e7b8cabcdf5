"""Tables by name or path: namespace, write, read, evolving append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

DEFAULT_FORMAT = "parquet"


def _is_path(target: str) -> bool:
    return "/" in target


def ensure_namespace(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create a schema unless it exists. `name` may be multi-part; parts are quoted."""
    quoted = ".".join(f"`{part}`" for part in name.replace("`", "").split("."))
    escaped = (location or "").replace("\\", "\\\\").replace("'", "\\'")
    where = f" LOCATION '{escaped}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {quoted}{where}")


def write_table(
    df: DataFrame,
    target: str,
    mode: str = "overwrite",
    partition_cols: Sequence[str] = (),
    fmt: str = DEFAULT_FORMAT,
) -> None:
    """Write to a table name or a path, replacing or appending.

    With partition columns the rows are rebalanced on them first: small partitions become one file
    each and a hot one is split over several tasks.
    """
    if partition_cols:
        df = df.hint("rebalance", *partition_cols)
    writer = df.write.format(fmt).mode(mode)
    if partition_cols:
        writer = writer.partitionBy(*partition_cols)
    if mode == "overwrite":
        writer = writer.option("overwriteSchema", "true")
    writer.save(target) if _is_path(target) else writer.saveAsTable(target)


def read_table(
    spark: SparkSession,
    target: str,
    filter_expr: str | None = None,
    fmt: str = DEFAULT_FORMAT,
    merge_schema: bool = False,
) -> DataFrame:
    """Read a table name or a path, optionally filtered by an SQL predicate."""
    if _is_path(target):
        rows = spark.read.format(fmt).option("mergeSchema", merge_schema).load(target)
    else:
        rows = spark.read.table(target)
    return rows.filter(filter_expr) if filter_expr else rows


def spread(df: DataFrame) -> DataFrame:
    """Deal a small input out to all cores if it has fewer splits than there are cores.

    An input of one row group would keep the whole first stage in one task. A large table has more
    splits than cores and passes unchanged, without a shuffle. Rows are dealt by a hash of all their
    columns, which unlike a round-robin deal needs no sort to be repeatable.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *df.columns)


def append_evolving(df: DataFrame, path: str, fmt: str = DEFAULT_FORMAT) -> None:
    """Append rows whose columns may differ from those already there.

    Read back with merge_schema; columns missing on either side are NULL.
    """
    write_table(df, path, mode="append", fmt=fmt)
