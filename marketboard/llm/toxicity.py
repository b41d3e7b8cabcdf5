"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Labelled rows, at most TRAIN_ROWS in the order of a hash, are the only ones that it learns from. N-grams, of words and
across them, are hashed to buckets and counted once in a text. The log-count ratio of a bucket tells how much likelier toxic texts have
it; buckets whose ratio stands out from chance become features with the ratio as their value, and logistic regression weighs
them. A text of any length is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketboard.llm.common import per_text, saved

ORDERS = (4, 5, 6, 7)
BUCKET_BITS = 20
#: Labelled rows that are learnt from at most.
TRAIN_ROWS = 16_384
#: Added to counts before ratios are taken.
SMOOTHING = 1.0
#: A bucket's ratio is used if it is so many standard errors from none; and so many buckets at most.
MIN_DEVIATIONS = 4.0
MAX_FEATURES = 16_384
PENALTY = 1e-4
STEPS = 400
TOXIC_FROM = 0.7

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd 32-bit multipliers of the rolling hash and of its final mix.
_STEP, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)
#: Characters of a text that are hashed at once.
BLOCK = 1 << 20


def _hashes(data: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of each order in a piece of text; all white space is alike."""
    code = np.where(_SPACE[data], np.uint8(32), data).astype(np.uint32)
    rolled = code
    for n in range(2, min(max(ORDERS), len(data)) + 1):
        rolled = rolled[:-1] * _STEP + code[n - 1 :]
        if n in ORDERS:
            hashed = rolled + np.uint32(n)
            yield (hashed ^ (hashed >> np.uint32(15))) * _MIX >> np.uint32(32 - BUCKET_BITS)


def _pieces(text: bytes) -> Iterator[np.ndarray]:
    """The text with a space at both ends, in pieces that overlap by the longest n-gram but one."""
    data = np.frombuffer(b" " + text + b" ", np.uint8)
    for begin in range(0, len(data), BLOCK):
        yield data[begin : begin + BLOCK + max(ORDERS) - 1]


def buckets(text: bytes) -> np.ndarray:
    """The buckets of all n-grams of a text, each once."""
    seen = [hashed for piece in _pieces(text) for hashed in _hashes(piece)]
    return np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.uint32)


def buckets_of_features(text: bytes, is_feature: np.ndarray) -> np.ndarray:
    """The buckets of a text that are features, each once."""
    seen = [hashed[is_feature[hashed]] for piece in _pieces(text) for hashed in _hashes(piece)]
    return np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.uint32)


@dataclass
class Model:
    """weight of every bucket (0: no feature), ratio included, and bias."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        is_feature = self.weights != 0
        values = np.array([self.bias + self.weights[buckets_of_features(t, is_feature)].sum() for t in texts])
        return 1 / (1 + np.exp(-np.clip(values, -30, 30)))


def labelled(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, learn: Column, most: int = TRAIN_ROWS) -> DataFrame:
    """text, label of the rows that are learnt from. A key with both labels, or with none, is left out."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & learn).groupBy(F.col(key).alias("key"))
    known = known.agg(F.min(label).alias("label"), F.max(label).alias("most")).filter("label = most").select("key", "label")
    # At most so many rows: their size is bounded, so they go to all tasks.
    known = known.orderBy(F.xxhash64("key"), "key").limit(most)
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(known), "key")
    return rows.select(F.col("text").cast("binary").alias("text"), F.col("label").cast("int").alias("label"))


def bucket_counts(rows: DataFrame) -> DataFrame:
    """cell, clean, toxic: texts of each label that have each bucket; the cell after the last bucket counts all texts."""
    size = 1 << BUCKET_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, size + 1), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[int(label > 0), buckets(text)] += 1
                counts[int(label > 0), size] += 1
        cell = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts[0, cell]), pa.array(counts[1, cell])], ["cell", "clean", "toxic"])

    cells = rows.select("text", "label").mapInArrow(run, "cell long, clean long, toxic long")
    return cells.groupBy("cell").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def log_ratios(cells: DataFrame, clean: int, toxic: int) -> DataFrame:
    """cell, ratio: naive Bayes log-count ratios of the buckets that stand out, the strongest ones if they are too many."""

    def share(count: str, total: int) -> Column:
        return (F.col(count) + SMOOTHING) / (total + 2 * SMOOTHING)

    def variance(count: str, total: int) -> Column:
        return (1 - share(count, total)) / (share(count, total) * (total + 2 * SMOOTHING))

    rows = cells.filter(F.col("cell") < 1 << BUCKET_BITS).withColumn("ratio", F.log(share("toxic", toxic) / share("clean", clean)))
    rows = rows.withColumn("strength", F.abs("ratio") / F.sqrt(variance("toxic", toxic) + variance("clean", clean)))
    rows = rows.filter(F.col("strength") >= MIN_DEVIATIONS)
    return rows.orderBy(F.desc("strength"), "cell").limit(MAX_FEATURES).select("cell", "ratio")


def fitted(rows: DataFrame) -> Model:
    """The classifier of a table (text as bytes, label); without texts of both labels it says one half of everything."""
    size = 1 << BUCKET_BITS
    cells = saved(bucket_counts(rows), "counts")
    totals = cells.filter(F.col("cell") == size).first()
    weights = np.zeros(size)
    if not totals or not totals["clean"] or not totals["toxic"]:
        return Model(weights, 0.0)
    features = log_ratios(cells, totals["clean"], totals["toxic"]).toArrow().sort_by("cell")
    cell, value = features.column("cell").to_numpy(), features.column("ratio").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = np.zeros(size, bool)
        chosen[cell] = True
        for batch in batches:
            found = [np.searchsorted(cell, buckets_of_features(t, chosen)).astype(np.int32) for t in batch.column(0).to_pylist()]
            listed = pa.array(found, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], listed], ["label", "mark", "features"])

    # Of a bounded number of rows, the features only; in an order of their own, so that reruns add up alike.
    marked = rows.select("text", "label", F.xxhash64("text").alias("mark"))
    got = marked.mapInArrow(run, "label int, mark long, features array<int>").toArrow().combine_chunks()
    got = got.take(pa.compute.sort_indices(got, [("label", "ascending"), ("mark", "ascending")]))
    listed = got.column("features").combine_chunks()
    target = (got.column("label").to_numpy() > 0).astype(float)
    weight, bias = regression(np.diff(listed.offsets.to_numpy()), listed.flatten().to_numpy(), value, target)
    weights[cell] = weight * value
    return Model(weights, bias)


def regression(sizes: np.ndarray, column: np.ndarray, value: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with a squared penalty by accelerated gradient steps.

    Row i has the next sizes[i] entries of column; feature j has value[j] where it occurs. Rows are taken in blocks of
    about BLOCK entries, which bounds what a step holds.
    """
    n, width = len(target), len(value)
    ends = np.append(0, np.cumsum(sizes))
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], BLOCK)), [0, n]))
    blocks = [(slice(a, b), np.repeat(np.arange(b - a), sizes[a:b]), column[ends[a] : ends[b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
    weight, bias = np.zeros(width), 0.0
    ahead, ahead_bias = weight, bias
    # The largest curvature is bounded by a quarter of the mean squared length of a row, which is met in practice.
    rate = 4.0 / (max(sum((value[c] ** 2).sum() for _, _, c in blocks) / n, 1.0) + 1.0)
    for step in range(STEPS):
        slope, total = np.zeros(width), 0.0
        weighed = value * ahead
        for rows, row, at in blocks:
            told = np.bincount(row, weighed[at], rows.stop - rows.start) + ahead_bias
            error = (1 / (1 + np.exp(-np.clip(told, -30, 30))) - target[rows]) / n
            slope += np.bincount(at, error[row], width)
            total += float(error.sum())
        new = ahead - rate * (value * slope + PENALTY * ahead)
        new_bias = ahead_bias - rate * total
        push = step / (step + 3)
        ahead, ahead_bias = new + push * (new - weight), new_bias + push * (new_bias - bias)
        weight, bias = new, new_bias
    return weight, bias


def scored(
    documents: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", toxic_from: float = TOXIC_FROM
) -> DataFrame:
    """key, score (0 to 1), predicted of every document, one row for each row.

    learn: a condition on the key for rows that may be learnt from. Null and empty texts are scored as empty ones. Repeated
    rows and repeated or null keys keep a row each; no documents, no rows; without labels of both kinds every
    score is one half. Columns other than key and text are not read.
    """
    spark = documents.sparkSession
    model = fitted(saved(labelled(documents, labels, key, text, label, learn), "labelled"))
    shared = spark.sparkContext.broadcast(model)

    def run(texts: list[bytes]) -> dict:
        score = shared.value.scores(texts)
        return {"score": score, "predicted": pa.array((score >= toxic_from).astype(np.int32))}

    return per_text(documents, key, text, "score double, predicted int", run)
