"""What several operators share: reading, saved tables, texts as bytes, hash splits."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketboard.sources.storage import work_path

#: Bytes of text that one call of a text function gets at most, besides a single longer text.
BATCH_BYTES = 8 << 20
#: Rows that a function of another column gets at most.
SLICE_ROWS = 256
#: In a chain of stages: bytes of a batch for Python, and rows that a Parquet reader decodes at once. An executor keeps what the
#: largest buffers of any stage took, in its heap, its native memory and its Python workers.
STAGE_BATCH_BYTES, STAGE_READ_ROWS = 1 << 20, 512


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Give tasks this package, for clusters on which it is not installed. Spark's own file server carries it.

    Batches for Python are bounded by bytes too: many rows of long texts would not fit a task.
    """
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='package-')}/marketboard_code", "zip", root, "marketboard")
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


def shipped_to_stage(spark: SparkSession) -> None:
    """The same for a stage of a chain, with small buffers: all stages run on the same executors."""
    shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(STAGE_BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(STAGE_READ_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, lineage cut, safe if executors go."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(key: Column, parts: int, part: int) -> Column:
    """True for rows whose crc32 of the key as text has this remainder; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def uniform_hash(*columns: Column) -> Column:
    """A number in [0, 1) from the columns, the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def slices(texts: list[bytes] | list[int], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive slices of at most so many bytes, from texts or their sizes; a longer text stands alone."""
    begin = total = 0
    for i, text in enumerate(texts):
        size = text if isinstance(text, int) else len(text)
        if i > begin and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(texts):
        yield begin, len(texts)


def per_text(
    df: DataFrame, key: str, text: str, schema: str, function: Callable[[list[bytes]], dict[str, Iterable]], extra: list[Column] | None = None
) -> DataFrame:
    """The key, extra columns and what the function says of each text, as bytes (null: empty).

    The function gets slices of bounded size and returns one list or array for each column of the schema.
    Extra columns are passed on unchanged and are not seen by the function.
    """
    source = df.select(
        F.col(key).alias("_key"),
        *[c.alias(f"_extra{i}") for i, c in enumerate(extra or [])],
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"),
    )
    names = [f.name for f in source.schema.fields[:-1]]
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    frame = df.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for begin, end in slices(texts):
                made = function(texts[begin:end])
                kept = [batch.column(n).slice(begin, end - begin) for n in names]
                yield pa.RecordBatch.from_arrays(kept + [_array(v) for v in made.values()], names + list(made))

    out = source.mapInArrow(run, ", ".join([*kinds, schema]))
    return out.select(F.col("_key").alias(key), *names[1:], *frame.columns)


def appended(df: DataFrame, column: str, name: str, kind: str, function: Callable[..., pa.Array], most: int | None = BATCH_BYTES) -> DataFrame:
    """The rows with one more column at the end, made from one of theirs.

    The function gets slices of the column: texts as a list of bytes (null: none) of at most so many bytes together,
    besides a single longer one, or with most=None any column as an array of SLICE_ROWS rows. Each slice is handed on with
    its rows before the next one is made, so a task holds the results of one slice only.
    """
    at = df.columns.index(column)
    source = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    schema = T.StructType([*source.schema.fields, T.StructField("_made", T._parse_datatype_string(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if most is None:
                bounds = [(i, min(i + SLICE_ROWS, len(batch))) for i in range(0, len(batch), SLICE_ROWS)]
            else:
                bounds = slices(pc.binary_length(batch.column(at)).fill_null(0).to_pylist(), most)
            for begin, end in bounds:
                part = batch.slice(begin, end - begin)
                values = part.column(at)
                made = function(values if most is None else values.cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, "_made"])

    return source.mapInArrow(run, schema).toDF(*df.columns, name)


def _array(values) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)
