"""Documents -> overlapping word chunks with dense global ids."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketboard.config import CHUNK_MIN_CHARS, CHUNK_OVERLAP_WORDS, CHUNK_WORDS
from marketboard.functions.text import word_windows, words
from marketboard.sources.storage import work_path
from marketboard.sources.tables import read_table, write_table

# monotonically_increasing_id counts within a task in its lower bits.
PLACE_BITS = 33


def exploded(rows: DataFrame, column: str, position: str, element: str) -> DataFrame:
    """Rows per array element with its 0-based position.

    Written as an outer explode: for an inner one the optimizer puts a size filter below, which
    would build the whole array a second time just to count it.
    """
    others = [c for c in rows.columns if c != column]
    outer = rows.select(*others, F.posexplode_outer(column).alias(position, element))
    return outer.filter(F.col(position).isNotNull())


def text_chunks(
    texts: DataFrame,
    text: str = "text",
    size: int = CHUNK_WORDS,
    overlap: int = CHUNK_OVERLAP_WORDS,
    min_chars: int | None = CHUNK_MIN_CHARS,
) -> DataFrame:
    """Replace the text column by one row per chunk: chunk_pos (0-based) and chunk.

    The chunks of a text are built as one array before they become rows, so the word list of a long
    text is never copied once per chunk.
    """
    others = [c for c in texts.columns if c != text]
    listed = texts.select(*others, words(F.col(text)).alias("_words"))
    chunked = listed.select(
        *others, word_windows(F.col("_words"), size, overlap, min_chars).alias("_chunks")
    )
    return exploded(chunked, "_chunks", "chunk_pos", "chunk")


def document_chunks(
    documents: DataFrame,
    size: int = CHUNK_WORDS,
    overlap: int = CHUNK_OVERLAP_WORDS,
    min_chars: int | None = CHUNK_MIN_CHARS,
) -> DataFrame:
    """One row per document with all its chunks in (page, position) order.

    Takes doc_id, crop, source_doc and pages (array of page texts); gives the array `chunks` of
    (page, text), pages counted from 1, instead of the pages.
    """
    listed = documents.withColumn("_words", F.transform("pages", words))
    per_page = listed.withColumn(
        "_runs", F.transform("_words", lambda w: word_windows(w, size, overlap, min_chars))
    )
    tagged = F.transform(
        "_runs",
        lambda runs, i: F.transform(
            runs,
            lambda run: F.struct((i + F.lit(1)).cast("int").alias("page"), run.alias("text")),
        ),
    )
    return per_page.withColumn("chunks", F.flatten(tagged)).drop("_words", "_runs", "pages")


def numbered(
    rows: DataFrame,
    order: Sequence[Column],
    number: str = "number",
    then: Callable[[DataFrame], DataFrame] | None = None,
    target: str | None = None,
) -> DataFrame:
    """The rows with a dense number from 0 in the given order, from a table that is written for it.

    Keys of any type that has an order will do; they may repeat and be NULL. Rows are dealt to ranges of the order whose
    bounds Spark samples, sorted within each and written with their range and place. A table of one row for each range
    then gives the number of the first row of each, and it is small enough to be sent to all tasks: rows move
    once, and not for the numbers. Rows that are equal in the whole order may part at a bound, so a hot key is split.
    `then` turns the sorted rows into those that are numbered, row by row and in place (chunks of texts).
    """
    spark = rows.sparkSession
    path = target or work_path(spark, "numbered")
    dealt = rows.withColumn("_any", F.rand(1))
    dealt = dealt.repartitionByRange(*order, "_any").sortWithinPartitions(*order, "_any").drop("_any")
    placed = (then(dealt) if then else dealt).withColumn("_at", F.monotonically_increasing_id())
    write_table(placed, path)
    table = read_table(spark, path).withColumn("_range", F.shiftright("_at", PLACE_BITS))
    # one row for each range, of which there are as many as tasks wrote them
    sizes = read_table(spark, path).groupBy(F.shiftright("_at", PLACE_BITS).alias("_range")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return table.join(F.broadcast(firsts), "_range").withColumn(number, F.col("_first") + place).drop("_range", "_first", "_at")


def document_order(documents: DataFrame, key: str = "doc_id") -> list[Column]:
    """Ascending keys, NULL last; equal keys by crop, source and a digest of the pages."""
    text = F.array_join(F.transform("pages", lambda p: F.coalesce(p, F.lit(""))), "\n")
    return [c.asc_nulls_last() for c in (F.col(key), F.col("crop"), F.col("source_doc"), F.md5(text))]


def numbered_chunks(
    documents: DataFrame, key: str = "doc_id", prefix: str = "chunk_", target: str | None = None, **chunking
) -> DataFrame:
    """number, chunk_id, key, crop, source_doc, page, text of all chunks of documents (see document_chunks).

    Numbers run from 0 in the order of document, page and position; chunk_id is the prefix and the number with four digits,
    more where needed. Documents without a key come last; documents with equal keys each keep their chunks. Every text is
    chunked once, as the numbered rows are written (to `target`, a path).
    """

    def cut(rows: DataFrame) -> DataFrame:
        listed = exploded(document_chunks(rows, **chunking), "chunks", "_pos", "_chunk")
        return listed.select(key, "crop", "source_doc", F.col("_chunk.page").alias("page"), F.col("_chunk.text").alias("text"))

    rows = numbered(documents, document_order(documents, key), "number", cut, target)
    name = F.format_string(prefix + "%04d", F.col("number"))
    return rows.select("number", name.alias("chunk_id"), key, "crop", "source_doc", "page", "text")


def chunk_table(documents: DataFrame, **kwargs) -> DataFrame:
    """chunk_id, crop, source_doc, page, text of all documents."""
    return numbered_chunks(documents, **kwargs).select("chunk_id", "crop", "source_doc", "page", "text")
