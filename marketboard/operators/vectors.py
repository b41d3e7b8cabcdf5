"""Text vectors and exact inner-product search."""

from __future__ import annotations

import math
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketboard.functions.text import words

VECTOR_SIZE = 256
# Most query values (rows x dimensions) that travel to every task; 4 M doubles are 32 MB.
MAX_SHIPPED_VALUES = 4_000_000
# Rows of one side of a grid cell when the queries do not fit that bound.
CELL_ROWS = 20_000
# Scores are compared at this precision, so equal vectors tie whatever the order of summation.
SCORE_DIGITS = 6
# Texts, and their characters, that a plugged-in encoder gets at once.
ENCODER_ROWS, ENCODER_CHARS = 1024, 1 << 22

HITS = "query_id bigint, id bigint, score double"


# ---- vectors from text ----------------------------------------------------------------------


def _tokens(texts: DataFrame, text: str) -> DataFrame:
    """A NULL text has no words, like an empty one."""
    lowered = texts.withColumn("_lower", F.lower(F.coalesce(F.col(text), F.lit(""))))
    return lowered.withColumn("_tokens", words(F.col("_lower"))).drop("_lower")


def fit_encoder(texts: DataFrame, text: str = "text", size: int = VECTOR_SIZE) -> PipelineModel:
    """Fit hashed term frequencies with inverse document frequency, scaled to unit length.

    Runs one job: a tree-aggregated document-frequency vector of `size` entries.
    """
    hashing = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=size)
    counted = hashing.transform(_tokens(texts, text))
    idf = IDF(inputCol="_tf", outputCol="_tfidf").fit(counted.select("_tf"))
    unit = Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0)
    return PipelineModel([hashing, idf, unit])


def encode(
    texts: DataFrame, encoder: PipelineModel, text: str = "text", output: str = "embedding"
) -> DataFrame:
    """Add the unit vector of each text as array<float>; a narrow transformation."""
    encoded = encoder.transform(_tokens(texts, text))
    vector = vector_to_array(F.col("_unit"), "float32")
    return encoded.withColumn(output, vector).drop("_tokens", "_tf", "_tfidf", "_unit")


def encode_with(
    texts: DataFrame,
    make_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
    text: str = "text",
    output: str = "embedding",
    model: str | None = None,
    batch_rows: int = ENCODER_ROWS,
    batch_chars: int = ENCODER_CHARS,
) -> DataFrame:
    """Plug in any batch text encoder; its vectors are scaled to unit length here.

    `make_encoder` runs in the tasks, once in each Python worker process for all tasks that it runs: a worker keeps the
    encoder of one name, `model`, until one of another name is asked for. Without a name each call of this
    function has its own. The encoder gets batches of at most `batch_rows` texts and `batch_chars` characters, besides a single
    longer text. A NULL text is encoded like an empty one; a zero vector stays zero.
    """
    name = model or uuid.uuid4().hex
    added = T.StructField(output, T.ArrayType(T.FloatType()))
    schema = T.StructType([*texts.schema.fields, added])

    def loaded() -> Callable[[list[str]], np.ndarray]:
        # The process keeps it under a module name, as this function itself is made anew in every task.
        kept = sys.modules.setdefault("_encoder_of_worker", types.ModuleType("_encoder_of_worker"))
        if getattr(kept, "name", None) != name:
            kept.encoder, kept.name = make_encoder(), name
        return kept.encoder

    def bounds(sizes: list[int]) -> Iterator[tuple[int, int]]:
        begin = total = 0
        for i, size in enumerate(sizes):
            if i > begin and (i - begin >= batch_rows or total + size > batch_chars):
                yield begin, i
                begin, total = i, 0
            total += size
        if begin < len(sizes):
            yield begin, len(sizes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = loaded()
        for batch in batches:
            asked = batch[text].fillna("").tolist()
            for begin, end in bounds([len(t) for t in asked]):
                matrix = np.asarray(encoder(asked[begin:end]), dtype=np.float64)
                length = np.linalg.norm(matrix, axis=1, keepdims=True)
                unit = (matrix / np.where(length == 0, 1.0, length)).astype(np.float32)
                yield batch.iloc[begin:end].assign(**{output: list(unit)})

    return texts.mapInPandas(run, schema)


def unit_length(rows: DataFrame, column: str = "embedding") -> DataFrame:
    squares = F.aggregate(
        F.transform(column, lambda v: v.cast("double") * v.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
    return (
        rows.withColumn("_norm", F.sqrt(squares))
        .withColumn(
            column,
            F.transform(
                column, lambda v: F.coalesce(F.try_divide(v.cast("double"), "_norm"), F.lit(0.0))
            ),
        )
        .drop("_norm")
    )


def centroids(vectors: DataFrame, label: str, column: str = "embedding") -> DataFrame:
    """Mean vector of each label, scaled to unit length. Partial means meet before the shuffle."""
    mean = Summarizer.mean(array_to_vector(F.col(column)))
    averaged = vectors.groupBy(label).agg(mean.alias("_mean"))
    return unit_length(averaged.select(label, vector_to_array("_mean").alias(column)), column)


# ---- search ---------------------------------------------------------------------------------


def _searcher(k: int, digits: int = SCORE_DIGITS, block: int = 256):
    """Build search(query_frame, vector_batches) -> hit frames, with the k best hits per query.

    If the frames have a column tag, queries and vectors meet that have the same tag. A vector that is
    NULL or holds NULL, NaN or an infinite element takes no part, on either side.
    The search is a nested function, so tasks get it by value and need not import this package.
    """

    def usable(frame: pd.DataFrame, key: str, width: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the matrix of the vectors that take part."""
        frame = frame[frame["embedding"].notna()]
        rows = frame["embedding"].tolist()
        widths = set(map(len, rows)) | ({width} if width else set())
        if len(widths) > 1:
            raise ValueError(f"vectors have different dimensions: {sorted(widths)}")
        flat = np.concatenate(rows).astype(np.float64) if rows else np.empty(0)
        matrix = flat.reshape(len(rows), widths.pop() if widths else 0)
        finite = np.isfinite(matrix).all(axis=1)
        return frame[key].to_numpy()[finite], matrix[finite]

    def best(asked: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, ...]:
        """The k best hits of every query by (score descending, id ascending)."""
        order = np.lexsort((ids, -scores, asked))
        asked, ids, scores = asked[order], ids[order], scores[order]
        place = np.arange(len(asked)) - np.searchsorted(asked, asked)
        return asked[place < k], ids[place < k], scores[place < k]

    def met(matrix: np.ndarray, rows: np.ndarray, ids: np.ndarray, start: int):
        """Hits of a block of queries: what may be among the k best before rounding, then exactly."""
        scores = matrix[start : start + block] @ rows.T
        if len(rows) > k:
            bound = np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k]
            asked, at = np.nonzero(scores >= (bound - 2 * 10.0**-digits)[:, None])
        else:
            asked, at = (x.ravel() for x in np.indices(scores.shape))
        return best(asked + start, ids[at], np.round(scores[asked, at], digits) + 0.0)

    def by_tag(frame: pd.DataFrame) -> Iterator[tuple[object, pd.DataFrame]]:
        return iter(frame.groupby("tag", sort=False)) if "tag" in frame.columns else iter([(None, frame)])

    def search(queries: pd.DataFrame, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asking = {tag: usable(some, "query_id", None) for tag, some in by_tag(queries)}
        asking = {tag: found for tag, found in asking.items() if len(found[0])}
        if not asking:
            return
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        held = {tag: [none] * -(-len(ids) // block) for tag, (ids, _) in asking.items()}
        for batch in batches:
            for tag, some in by_tag(batch):
                if tag not in asking:
                    continue
                matrix, best_yet = asking[tag][1], held[tag]
                ids, rows = usable(some, "id", matrix.shape[1])
                if not len(ids):
                    continue
                for i in range(len(best_yet)):
                    more = met(matrix, rows, ids, i * block)
                    best_yet[i] = best(*(np.concatenate(pair) for pair in zip(best_yet[i], more, strict=True)))
        for tag, found in held.items():
            for asked, ids, scores in found:
                if len(asked):
                    yield pd.DataFrame({"query_id": asking[tag][0][asked], "id": ids, "score": scores})

    return search


class QuerySize(NamedTuple):
    rows: int
    dimensions: int


def query_size(queries: DataFrame) -> QuerySize:
    """Count the queries; runs a job over the query side only."""
    dimensions = F.coalesce(F.max(F.size("embedding")), F.lit(0))
    return QuerySize(*queries.agg(F.count("*"), dimensions).first())


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    tagged: bool = False,
    size: QuerySize | None = None,
    max_shipped: int = MAX_SHIPPED_VALUES,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Exact inner-product top-k of every query: query_id, id, score, rank.

    queries: query_id, embedding (and tag); vectors: id, embedding (and tag); ids are bigint. With
    `tagged`, a query only meets vectors of its own tag. Order: score at six decimals, then id.
    Vectors that are NULL or hold NULL, NaN or infinite elements take no part; vectors of different
    lengths end the job with an error.

    The query side is counted first (a job of its own). If it fits `max_shipped` values it goes to
    every task and the vectors are scanned in place, each task passing on k hits per query, with tags as without.
    Otherwise both sides are cut into cells of about `cell_rows` rows that meet
    pairwise by an equi-join on the cell number and the tag; each cell passes on k hits per query
    as well.
    """
    extra = ["tag"] if tagged else []
    queries = queries.select("query_id", "embedding", *extra)
    vectors = vectors.select("id", "embedding", *extra)
    size = size or query_size(queries)
    if size.rows * size.dimensions <= max_shipped:
        # a missing tag equals no other
        some, among = (x.filter(F.col("tag").isNotNull()) if tagged else x for x in (queries, vectors))
        hits = _scan(some.toPandas(), among, k)
    else:
        hits = _grid(queries, vectors, k, extra, size.rows, cell_rows)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _scan(query_frame: pd.DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    search = _searcher(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return search(query_frame, batches)

    return vectors.mapInPandas(run, HITS)


def _grid(
    queries: DataFrame, vectors: DataFrame, k: int, tag: list[str], query_rows: int, cell_rows: int
) -> DataFrame:
    """Blocks of queries against blocks of vectors; the hash of the unique ids sets the block."""
    across = max(1, math.ceil(query_rows / cell_rows))
    down = math.ceil(max(vectors.count(), 1) / cell_rows)

    def block(column: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    # a missing tag equals no other
    tags = [F.col(t).isNotNull() for t in tag] or [F.lit(True)]
    left = queries.filter(tags[0]).withColumn("_q", block("query_id", across))
    right = vectors.filter(tags[0]).withColumn("_v", block("id", down))
    left, right = left.withColumn("_v", every(down)), right.withColumn("_q", every(across))
    cells = ["_q", "_v", *tag]
    search = _searcher(k)

    def cell(some_queries: pd.DataFrame, some_vectors: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "id": [], "score": []}).astype(
            {"query_id": "int64", "id": "int64", "score": "float64"}
        )
        return pd.concat([none, *search(some_queries, iter([some_vectors]))])

    return left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInPandas(cell, HITS)
