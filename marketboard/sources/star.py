"""Model tables derived from a star schema of Parquet tables.

The folder holds lineitem, part, supplier, nation, region, events, documents and embeddings. Each
function derives one input of the operators from whole tables, untidy rows included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketboard.functions.names import canonical_name
from marketboard.sources.tables import spread

# Some product types go by an alias, the rest by their title-cased name.
ALIASES = {"large": "Onion", "small": "Tomato"}
CROPS = ["Onion", "Tomato", "Economy", "Medium", "Promo", "Standard"]
MANDIS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
LANGUAGE_CROPS = {"en": "Onion", "de": "Tomato", "fr": "Standard", "es": "Promo"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(
    spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str]
) -> DataFrame:
    """Some columns of a table that carries the work of a query."""
    return spread(table(spark, sf_dir, name).select(*columns))


def price_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw price rows, one per line item: product type as crop, region as market.

    Certain discount/tax combinations carry faults: a date in another format, no price, a zero or
    negative price, a name with a leading blank.
    """
    lines = spread_table(
        spark, sf_dir, "lineitem",
        ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # One dimension after the other: each side is a plain scan whose size Spark knows, so it picks
    # broadcast or shuffle by measure.
    joined = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    discount, tax, price = F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice")
    day_first = (discount == 0.1) & (tax == 0.08)
    return joined.select(
        F.when(day_first, F.date_format("l_shipdate", "dd/MM/yyyy"))
        .otherwise(F.col("l_shipdate").cast("date").cast("string"))
        .alias("date"),
        F.when((discount == 0.1) & (tax == 0.01), F.concat(F.lit(" "), F.col("p_type")))
        .otherwise(F.col("p_type"))
        .alias("crop"),
        F.col("r_name").alias("mandi"),
        F.col("n_name").alias("state"),
        F.when((discount == 0.0) & (tax == 0.0), F.lit(None))
        .when((discount == 0.0) & (tax == 0.08), F.lit(0.0))
        .when((discount == 0.0) & (tax == 0.07), F.lit(0.0) - price)
        .otherwise(price)
        .alias("modal_price"),
        (price - F.col("l_quantity")).alias("min_price"),
        (price + F.col("l_quantity")).alias("max_price"),
        F.col("l_quantity").alias("arrivals_tonnes"),
    )


def weather_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast documents from events: mandi, period (first of three days), document.

    A document lists the three-hour slots of its period; the mean event weight of a slot becomes
    its rain, and slots of low weight carry none. Slots are summed before they meet in a list, which
    then holds at most 24 entries.
    """
    day = F.col("ts").cast("date")
    age = F.datediff(day, F.lit("2024-01-01").cast("date"))
    start = F.date_sub(day, F.pmod(age, F.lit(3)))
    slot = F.pmod(age, F.lit(3)) * F.lit(8) + F.floor(F.hour("ts") / F.lit(3)).cast("int")
    weight = F.get_json_object("props", "$.k").cast("bigint")
    slots = (
        spread_table(spark, sf_dir, "events", ["user_id", "ts", "props"])
        .select(
            F.pmod("user_id", F.lit(5)).cast("int").alias("market"),
            start.alias("period"), slot.alias("slot"), weight.alias("k"),
        )
        .groupBy("market", "period", "slot")
        .agg(F.call_function("div", F.sum("k"), F.count("k")).alias("k"))
    )
    # some markets are wetter than others; a power of two keeps the sums exact
    share = F.lit(30) + F.lit(3) * F.col("market")
    rain = F.when(
        F.col("k") >= 40, F.struct((F.col("k") * share / F.lit(8192.0)).alias("3h"))
    )
    listed = slots.groupBy("market", "period").agg(
        F.array_sort(F.collect_list(F.struct("slot", rain.alias("rain")))).alias("slots")
    )
    regions = table(spark, sf_dir, "region")
    return listed.join(regions, F.col("market") == F.col("r_regionkey")).select(
        F.col("r_name").alias("mandi"),
        "period",
        F.to_json(
            F.struct(F.transform("slots", lambda s: F.struct(s["rain"].alias("rain"))).alias("list"))
        ).alias("document"),
    )


def latest_weather_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of the last period of each market."""
    return (
        weather_documents(spark, sf_dir)
        .groupBy("mandi")
        .agg(F.max_by("document", "period").alias("document"))
    )


def advisory_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, crop, source_doc, pages: a line of the text is a page, the language names the crop."""
    columns = ["doc_id", "text", "lang", "source"]
    return spread_table(spark, sf_dir, "documents", columns).select(
        "doc_id",
        canonical_name(F.col("lang"), LANGUAGE_CROPS).alias("crop"),
        F.col("source").alias("source_doc"),
        F.split("text", "\n").alias("pages"),
    )


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, embedding, crop: the label of a vector stands for its crop."""
    columns = ["vec_id", "embedding", "label"]
    return spread_table(spark, sf_dir, "embeddings", columns).select(
        F.col("vec_id").alias("id"),
        "embedding",
        F.concat(F.lit("Crop"), F.col("label").cast("string")).alias("crop"),
    )
