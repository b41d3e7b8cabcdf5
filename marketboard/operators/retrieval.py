"""Passages for a query: scored, filtered, unscored, and as one context text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketboard.config import OVER_FETCH, TOP_K
from marketboard.functions.names import same_name
from marketboard.functions.text import filled
from marketboard.operators.vectors import nearest, query_size
from marketboard.sources.storage import work_path


def retrieve(
    queries: DataFrame,
    vectors: DataFrame,
    top_k: int = TOP_K,
    over_fetch: int = OVER_FETCH,
    prefilter: bool = False,
    **search,
) -> DataFrame:
    """Best passages per query: query_id, rank, score and the columns of the passage.

    queries: query_id, embedding, crop (NULL asks for any crop). vectors: id, embedding, crop, ....
    Default: the top_k * over_fetch nearest of all vectors are found first and the crop is checked
    after, so a query may get fewer than top_k passages. With `prefilter`, only vectors of the
    wanted crop compete, for a query without a crop all of them.

    The queries are saved first, so they are computed once, and so are the hits: their size is then known when the join
    with the passages is planned, and a few of them meet these where they lie.
    """
    path = work_path(queries.sparkSession, "queries")
    queries.select("query_id", "embedding", "crop").write.parquet(path)
    queries = queries.sparkSession.read.parquet(path)
    if prefilter:
        tagged = queries.filter(F.col("crop").isNotNull()).withColumn("tag", F.lower("crop"))
        own = vectors.withColumn("tag", F.lower("crop"))
        hits = nearest(tagged, own, top_k, tagged=True, **search)
        untagged = queries.filter(F.col("crop").isNull())
        size = query_size(untagged)
        if size.rows:
            hits = hits.union(nearest(untagged, vectors, top_k, size=size, **search))
    else:
        hits = nearest(queries, vectors, top_k * over_fetch, **search)
    wanted = queries.select("query_id", F.col("crop").alias("_wanted"))
    found = work_path(queries.sparkSession, "hits")
    hits.drop("rank").join(wanted, "query_id").write.parquet(found)
    asked = queries.sparkSession.read.parquet(found)
    fitting = vectors.drop("embedding").join(asked, "id").filter(
        F.col("_wanted").isNull() | same_name(F.col("crop"), F.col("_wanted"))
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return (
        fitting.drop("_wanted")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top_k)
    )


def _stored_order(passages: DataFrame, column: str) -> list[Column]:
    """Ascending order of numbers, or of texts that end in a running number: shorter ones first."""
    if isinstance(passages.schema[column].dataType, T.StringType):
        return [F.length(column), F.col(column)]
    return [F.col(column)]


def first_passages(passages: DataFrame, top_k: int = TOP_K, order: str = "id") -> DataFrame:
    """Unscored retrieval for all crops at once: the first top_k passages in stored order.

    Crops compare without regard to case; the column crop_key holds the lower-cased name. Give it a stored table whose
    order column is unique: the ranks are found from the two columns crop and order alone, of which each task passes on
    top_k rows for a crop, and written; texts are then read for those few rows where they lie, without an exchange.
    """
    keyed = passages.select(F.lower("crop").alias("crop_key"), order)
    stored = Window.partitionBy("crop_key").orderBy(*_stored_order(passages, order))
    ranked = keyed.withColumn("rank", F.row_number().over(stored)).filter(F.col("rank") <= top_k)
    path = work_path(passages.sparkSession, "first")
    # written, so that its size is known when the join is planned
    ranked.write.parquet(path)
    return passages.join(passages.sparkSession.read.parquet(path), order)


def first_passages_any(passages: DataFrame, top_k: int = TOP_K, order: str = "id") -> DataFrame:
    """Unscored retrieval without a crop: the first top_k passages of all."""
    stored = _stored_order(passages, order)
    top = passages.orderBy(*stored).limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*stored)))


def ranked_lists(passages: DataFrame, keys: list[str]) -> DataFrame:
    """The passages of a key as one array in rank order: columns keys, passages.

    Give it the output of a retrieval, which holds at most top_k passages per key.
    """
    entry = F.struct("rank", "source_doc", "crop", "page", "text")
    return passages.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("passages"))


def context_text(listed: Column) -> Column:
    """An array of passages as one numbered text."""
    # ---- fixed values: layout of one entry --------------------------------------------------
    def entry(p: Column, i: Column) -> Column:
        return F.concat(
            F.lit("[Advisory "), (i + F.lit(1)).cast("string"),
            F.lit("] Source: "), filled(p["source_doc"], "unknown"),
            F.lit(" | Crop: "), filled(p["crop"], "?"),
            F.lit(" | Page: "), filled(p["page"], "?"),
            F.lit("\n"), p["text"],
        )

    return F.array_join(F.transform(listed, entry), "\n\n")


def context_blocks(passages: DataFrame, keys: list[str]) -> DataFrame:
    """All passages of a key as one numbered text, in rank order: columns keys, context."""
    listed = ranked_lists(passages, keys)
    return listed.select(*keys, context_text(F.col("passages")).alias("context"))
