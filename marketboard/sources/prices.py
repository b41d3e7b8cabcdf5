"""Price rows from CSV and JSON files."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_COLUMNS = ["date", "crop", "mandi"]
NUMBER_COLUMNS = ["modal_price", "min_price", "max_price", "arrivals_tonnes"]
PRICE_COLUMNS = TEXT_COLUMNS + NUMBER_COLUMNS

PRICE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), True) for c in TEXT_COLUMNS]
    + [T.StructField(c, T.DoubleType(), True) for c in NUMBER_COLUMNS]
)

# ---- fixed values: field names of the price service -> ours ----------------------------------
RECORD_FIELDS = {
    "Arrival_Date": "date",
    "Commodity": "crop",
    "Market": "mandi",
    "Modal_x0020_Price": "modal_price",
    "Min_x0020_Price": "min_price",
    "Max_x0020_Price": "max_price",
    "Arrivals_x0020_in_x0020_Qtl": "arrivals_tonnes",
}


def csv_schema(spark: SparkSession, path: str) -> T.StructType:
    """Schema of a folder of CSV files in the order of their header; unknown columns are text.

    Reads one header line.
    """
    names = spark.read.option("header", True).csv(path).columns
    known = {f.name: f for f in PRICE_SCHEMA.fields}
    return T.StructType([known.get(n, T.StructField(n, T.StringType(), True)) for n in names])


def header_schema(header: str) -> T.StructType:
    """Schema of a CSV file from its header line: known columns with their types, others as text.

    Names are trimmed and compared without regard to case. A column without a name, or with one that came before, is named
    by its place.
    """
    known = {f.name: f for f in PRICE_SCHEMA.fields}
    fields, taken = [], set()
    for place, name in enumerate(next(csv.reader([header.removeprefix("\ufeff")]), [])):
        name = name.strip().lower()
        if not name or name in taken:
            name = f"column_{place}"
        taken.add(name)
        fields.append(known.get(name, T.StructField(name, T.StringType(), True)))
    return T.StructType(fields)


def select_price_columns(rows: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The price columns by name; one that the source lacks is NULL."""
    wanted = [*PRICE_COLUMNS, *(extra or [])]
    types = {f.name: f.dataType for f in PRICE_SCHEMA.fields}
    return rows.select(
        *[
            F.col(c) if c in rows.columns
            else F.lit(None).cast(types.get(c, T.StringType())).alias(c)
            for c in wanted
        ]
    )


def csv_options(rows):
    """Options of both readers. A number that does not parse becomes NULL; a file whose header
    departs from the schema stops the job instead of shifting its columns."""
    return rows.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)


def read_price_csv(spark: SparkSession, path: str, extra: list[str] | None = None) -> DataFrame:
    """Typed price rows from CSV files with a header, bound by column name."""
    reader = csv_options(spark.read).schema(csv_schema(spark, path))
    return select_price_columns(reader.csv(path), extra)


def export_csv(rows: DataFrame, path: str, files: int | None = None) -> None:
    """Write CSV with a header. `files=1` gives a single file through a single task; leave it
    unset for anything large."""
    if files is not None:
        rows = rows.coalesce(files)
    writer = rows.write.mode("overwrite").option("header", True)
    for side in ("Leading", "Trailing"):  # the writer trims texts unless told not to
        writer = writer.option(f"ignore{side}WhiteSpace", False)
    writer.csv(path)


def price_records(documents: DataFrame, records: str = "records") -> DataFrame:
    """Flatten service replies into price rows: one row per element of the records array.

    Fields that a reply lacks are NULL, as are numbers that do not parse.
    """
    rows = documents.select(F.explode(records).alias("_r"))
    have = {f.name for f in rows.schema["_r"].dataType.fields}

    def field(source: str, target: str):
        value = F.col("_r").getField(source) if source in have else F.lit(None).cast("string")
        kind = "double" if target in NUMBER_COLUMNS else "string"
        return value.try_cast(kind).alias(target)

    return rows.select(*[field(s, t) for s, t in RECORD_FIELDS.items()])


def record_schema() -> T.StructType:
    """Schema of a service reply; every field is text."""
    record = T.StructType([T.StructField(f, T.StringType(), True) for f in RECORD_FIELDS])
    return T.StructType([T.StructField("records", T.ArrayType(record), True)])


def read_price_json(spark: SparkSession, path: str) -> DataFrame:
    return price_records(spark.read.schema(record_schema()).json(path))


def load_prices(rows: DataFrame, target: str, **kwargs) -> None:
    """Replace the raw price table by already typed rows."""
    from marketboard.sources.tables import write_table

    write_table(rows, target, mode="overwrite", **kwargs)
