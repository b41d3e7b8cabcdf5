"""Incremental file ingest: every file not yet seen, then stop."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketboard.sources.prices import csv_options, csv_schema, header_schema, select_price_columns
from marketboard.sources.tables import DEFAULT_FORMAT


def ingest_price_csv(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    extra: list[str] | None = None,
    fmt: str = DEFAULT_FORMAT,
    max_files_per_batch: int | None = None,
) -> None:
    """Append all pending CSV files of `source` to `target` and wait for the end.

    The checkpoint remembers finished files, so a rerun adds only new ones and a run that lost
    executors or its driver resumes where it was. The folder holds files of one layout; run one
    ingest per folder.
    """
    reader = csv_options(spark.readStream).schema(csv_schema(spark, source))
    if max_files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    rows = select_price_columns(reader.csv(source), extra)
    writer = (
        rows.writeStream.format(fmt)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("mergeSchema", "true")
        .trigger(availableNow=True)
    )
    query = writer.start(target) if "/" in target else writer.toTable(target)
    query.awaitTermination()


def _layouts(lines: DataFrame) -> dict[str, list[str]]:
    """The files of a batch by their header line; lines has value, path and start (of the line's split in its file)."""
    numbered = lines.filter("start = 0").withColumn("_at", F.monotonically_increasing_id())
    headers = numbered.groupBy("path").agg(F.min_by("value", "_at").alias("header"))
    # one row for each file of the batch, which the source's own log on the driver lists as well
    found: dict[str, list[str]] = {}
    for row in headers.orderBy("path").collect():
        # the path comes as a URI, and a reader takes patterns
        path = re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(row["path"]))
        found.setdefault(row["header"], []).append(path)
    return found


def read_by_header(spark: SparkSession, lines: DataFrame) -> DataFrame | None:
    """Typed rows of all files of a batch, each bound by its own header; None if the files are empty.

    The columns are the price columns and whatever else some file has, as text; a column that a file lacks is NULL.
    """
    parts = []
    for header, paths in _layouts(lines).items():
        schema = header_schema(header)
        rows = csv_options(spark.read).option("enforceSchema", True).schema(schema).csv(paths)
        others = [c for c in schema.names if c not in select_price_columns(rows).columns]
        parts.append(select_price_columns(rows, others))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def ingest_evolving_csv(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    fmt: str = DEFAULT_FORMAT,
    max_files_per_batch: int | None = None,
    store: Callable[[DataFrame, str], None] | None = None,
) -> None:
    """Append all pending CSV files of `source`, whatever their layouts, to the table at the path `target`; wait for the end.

    Layouts may differ from file to file and change over time. Each batch writes a folder of its own, named by its number
    and replaced if the batch is repeated: a run that fails while it writes, or before the checkpoint knows of it, leaves no
    copies behind. Read the table with merge_schema; batch_id tells which batch a row came with. `store` writes a batch's rows
    to its folder in another way.
    """

    def write(rows: DataFrame, folder: str) -> None:
        rows.write.format(fmt).mode("overwrite").save(folder)

    def sink(batch: DataFrame, number: int) -> None:
        rows = read_by_header(batch.sparkSession, batch)
        if rows is not None:
            (store or write)(rows, f"{target}/batch_id={number}")

    reader = spark.readStream
    if max_files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    place = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")
    lines = reader.text(source).select("value", *place)
    query = lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
