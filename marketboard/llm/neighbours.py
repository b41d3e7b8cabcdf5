"""Approximate nearest neighbours: a forest of random-projection trees.

The trees are grown on a bounded sample: each node splits its points at the median of their projection on the line between two
of them. Every vector is then indexed, once in each tree. A query walks all trees through one priority queue, ordered by
the smallest margin by which the path to a node missed the query, until the leaves that it has reached hold enough
candidates; these are ranked by their exact distance. How many are enough is measured in each run, on some queries whose
nearest vectors are found among all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketboard.llm.common import saved

TREES = 48
#: Vectors on which the trees are grown, at most, in the order of a hash.
SAMPLE_ROWS = 50_000
#: Indexed vectors in a leaf, about; and the least sampled ones, which bounds the forest.
LEAF_ROWS = 24
LEAF_SAMPLES = 6
#: The leaves of one query hold as many indexed vectors, counted in each tree, as it takes to reach so many of the nearest vectors
#: of so many queries. 0.9 is asked; the rest is a margin.
RECALL, RECALL_QUERIES = 0.94, 128
#: Queries whose vectors a task holds at once, and the cells over which the vectors that a block of queries met are spread.
QUERY_BLOCK, CELLS = 4096, 32
#: Pairs whose distances a task computes at once.
PAIRS = 1 << 15
NEIGHBOURS = 10
SEED = 11


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    limit = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def grown_tree(sample: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normals, thresholds and children of the nodes of one tree; the root is node 0, a child below zero is a leaf."""
    random = np.random.default_rng(seed)
    normals, thresholds, children = [], [], []
    leaves = 0

    def split(rows: np.ndarray) -> tuple[np.ndarray, np.float32, np.ndarray] | None:
        for _ in range(3):
            one, two = random.choice(len(rows), 2, replace=False)
            normal = sample[rows[one]] - sample[rows[two]]
            if np.any(normal):
                normal = normal / np.linalg.norm(normal)
                at = sample[rows] @ normal
                threshold = np.float32(np.median(at))
                right = at > threshold
                return (normal, threshold, right) if right.any() and not right.all() else None
        return None

    # (rows, depth left, the parent node and side that lead here)
    waiting = [(np.arange(len(sample)), depth, -1, 0)]
    while waiting:
        rows, left, parent, side = waiting.pop()
        found = split(rows) if left > 0 and len(rows) >= 2 * LEAF_SAMPLES else None
        if found or parent < 0:
            # A root without a split gets one that sends everything to its first child.
            normal, threshold, right = found or (np.zeros(sample.shape[1], np.float32), np.float32(0), None)
            name = len(thresholds)
            normals.append(normal)
            thresholds.append(threshold)
            children.append([-1, -1])
            if found:
                waiting += [(rows[right], left - 1, name, 1), (rows[~right], left - 1, name, 0)]
            else:
                leaves = 1
        else:
            leaves += 1
            name = -leaves
        if parent >= 0:
            children[parent][side] = name
    return np.array(normals, np.float32), np.array(thresholds, np.float32), np.array(children, np.int64)


class Forest:
    """Trees in flat arrays: normals, thresholds and children of all nodes; leaves are numbered below zero."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.normals = np.concatenate([t[0] for t in trees])
        self.thresholds = np.concatenate([t[1] for t in trees])
        self.roots = np.append(0, np.cumsum([len(t[1]) for t in trees]))[:-1].tolist()
        moved, leaves = [], 0
        for root, (_, _, children) in zip(self.roots, trees, strict=True):
            moved.append(np.where(children >= 0, children + root, children - leaves))
            leaves += int(-children.min())
        self.children = np.concatenate(moved)

    def leaf_of(self, vectors: np.ndarray, root: int) -> np.ndarray:
        at = np.full(len(vectors), root)
        inner = np.flatnonzero(at >= 0)
        while len(inner):
            nodes = at[inner]
            side = np.einsum("ij,ij->i", vectors[inner], self.normals[nodes]) > self.thresholds[nodes]
            at[inner] = self.children[nodes, side.astype(np.int64)]
            inner = inner[at[inner] >= 0]
        return at

    def search(self, vector: np.ndarray, sizes: np.ndarray, enough: float) -> list[int]:
        """Leaves in the order of the shared queue until they hold enough rows; sizes: by the leaf's number."""
        margins = self.normals @ vector - self.thresholds
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        found, held = [], 0
        while queue and held < enough:
            missed, at = heapq.heappop(queue)
            while at >= 0:
                margin = float(margins[at])
                near, far = self.children[at][::-1] if margin > 0 else self.children[at]
                heapq.heappush(queue, (max(missed, abs(margin)), int(far)))
                at = int(near)
            found.append(at)
            held += int(sizes[-at])
        return found


def _matrix(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def classes(vectors: DataFrame, key: str, vector: str, neighbours: int) -> DataFrame:
    """code, vector, ids: one row for each different vector with the smallest ids that have it, enough for any answer."""
    rows = vectors.filter(usable(F.col(vector)) & F.col(key).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).withColumn("code", F.xxhash64("vector"))
    first = Window.partitionBy("code").orderBy("id")
    few = rows.withColumn("place", F.dense_rank().over(first)).filter(F.col("place") <= neighbours + 1)
    return few.groupBy("code").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_set("id")).alias("ids"))


def grown(indexed: DataFrame, rows: int, trees: int = TREES) -> Forest | None:
    """A forest on the vectors that come first by hash, the only step that does not see the whole table.

    Each tree is grown in a task of its own from the sample.
    """
    spark = indexed.sparkSession
    sample = indexed.orderBy(F.xxhash64("code"), "code").limit(SAMPLE_ROWS).select(F.col("vector").cast("array<float>")).toArrow()
    column = sample.column(0).combine_chunks()
    if not len(column):
        return None
    widths = set(np.diff(column.offsets.to_numpy()))
    if len(widths) > 1:
        raise ValueError(f"vectors have different dimensions: {sorted(widths)}")
    depth = max(0, int(np.ceil(np.log2(max(rows, 1) / LEAF_ROWS))))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                parts = grown_tree(shared.value, depth, SEED + tree)
                yield pa.RecordBatch.from_arrays([pa.array([tree]), *(pa.array([p.tobytes()]) for p in parts)], ["tree", "a", "b", "c"])

    width = int(widths.pop())
    shared = spark.sparkContext.broadcast(_matrix(column, width, np.float32))
    del sample, column
    # At most one leaf for LEAF_SAMPLES sampled vectors in each tree.
    made = spark.range(trees, numPartitions=trees).mapInArrow(grow, "tree long, a binary, b binary, c binary").toArrow().sort_by("tree")
    shared.destroy()
    rows = zip(*(made.column(c) for c in "abc"), strict=True)
    return Forest(
        [
            (
                np.frombuffer(a.as_buffer(), np.float32).reshape(-1, width),
                np.frombuffer(b.as_buffer(), np.float32),
                np.frombuffer(c.as_buffer(), np.int64).reshape(-1, 2),
            )
            for a, b, c in rows
        ]
    )


def _reranked(width: int, most: int):
    """A task's work on rows by (block, salt): first a block's queries, then vectors and the queries that met them.

    Gives the best codes of each query in each batch. A task holds the vectors of one block of queries at a time.
    """

    def ranked(asks: np.ndarray, places: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
        code, least = rows.column("ask").to_numpy(), rows.column("least").to_numpy()
        vectors, met = _matrix(rows.column("vector"), width), rows.column("asks")
        row = np.repeat(np.arange(len(rows)), met.value_lengths().to_numpy())
        ask = np.searchsorted(asks, met.flatten().to_numpy())
        score = np.empty(len(row))
        for begin in range(0, len(row), PAIRS):
            part = slice(begin, begin + PAIRS)
            score[part] = np.sqrt(((vectors[row[part]] - places[ask[part]]) ** 2).sum(axis=1))
        by = np.lexsort((least[row], score, ask))
        by = by[np.arange(len(by)) - np.searchsorted(ask[by], ask[by]) < most]
        columns = [asks[ask[by]], code[row[by]], least[row[by]], score[by]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["ask", "code", "least", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, points = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(name).to_numpy() for name in ("block", "salt", "is_vector")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                rows = batch.slice(begin, end - begin)
                if not len(rows):
                    continue
                block, salt, is_vector = keys[:, begin].tolist()
                if (block, salt) != cell:
                    cell, held, points = (block, salt), [], None
                if not is_vector:
                    held.append((rows.column("ask").to_numpy(), _matrix(rows.column("vector"), width)))
                else:
                    if points is None:
                        asks, places = (np.concatenate(x) for x in zip(*held, strict=True))
                        order = np.argsort(asks)
                        points, held = (asks[order], places[order]), []
                    yield ranked(*points, rows)

    return run


def _closest(asks: np.ndarray, points: np.ndarray, most: int):
    """A task's work on codes and vectors: the best codes of each query among all rows of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            code, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1), points.shape[1])
            apart = (points**2).sum(axis=1)[:, None] + (vectors**2).sum(axis=1) - 2 * points @ vectors.T
            apart[asks[:, None] == code] = np.inf
            best = np.argpartition(apart, most - 1, axis=1)[:, :most] if len(code) > most else np.tile(np.arange(len(code)), (len(asks), 1))
            columns = [np.repeat(asks, best.shape[1]), code[best].ravel(), np.take_along_axis(apart, best, axis=1).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["ask", "code", "apart"])

    return run


def enough_rows(forest: Forest, sizes: np.ndarray, indexed: DataFrame, places: DataFrame, asked: DataFrame, neighbours: int, least: float) -> float:
    """Rows that the leaves of a query have to hold for RECALL, from queries that come first by hash; at least the given ones."""
    least = max(least, float(TREES * neighbours))
    some = asked.select("ask").distinct().orderBy(F.xxhash64("ask"), "ask").limit(RECALL_QUERIES)
    some = indexed.select(F.col("code").alias("ask"), "vector").join(F.broadcast(some), "ask").toArrow()
    if not len(some):
        return least
    asks, points = some.column("ask").to_numpy(), _matrix(some.column("vector").combine_chunks(), forest.normals.shape[1])
    near = indexed.select("code", "vector").mapInArrow(_closest(asks, points, neighbours), "ask long, code long, apart double")
    order = Window.partitionBy("ask").orderBy("apart", "code")
    near = near.filter(F.col("apart") < float("inf")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= neighbours)
    near = saved(near.select("ask", "code"), "nearest")
    # At most RECALL_QUERIES * neighbours vectors, each in one leaf of each tree.
    homes = places.join(F.broadcast(near), "code").select("ask", "code", "leaf").toPandas()
    if homes.empty:
        return least
    leaves_of = {ask: rows for ask, rows in homes.groupby("ask")}
    enough = least
    while True:
        needed = []
        for ask, point in zip(asks, points.astype(np.float32), strict=True):
            if ask in leaves_of:
                found = np.array(forest.search(point, sizes, enough))
                held = np.cumsum(sizes[-found]) - sizes[-found]
                before = dict(zip(found.tolist(), held.tolist(), strict=True))
                at = leaves_of[ask]["leaf"].map(before).astype(float).fillna(np.inf)
                needed += at.groupby(leaves_of[ask]["code"]).min().tolist()
        reach = np.sort(needed)[int(np.ceil(RECALL * len(needed))) - 1]
        # The walk goes on as long as its leaves hold less.
        if np.isfinite(reach):
            return max(least, reach + 1)
        enough *= 2


def nearest(
    vectors: DataFrame,
    queries: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    neighbours: int = NEIGHBOURS,
    search_factor: float = 0,
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest other vectors that the forest finds for every row that is a query.

    score is the Euclidean distance in double precision; ties go to the smaller id. Null, zero and non-finite vectors and
    rows without an id take no part. Equal vectors are indexed once and answer with all ids that can be among the nearest; rows
    with equal ids and vectors count once. Vectors of different lengths raise an error. No vectors: no rows.
    """
    spark = vectors.sparkSession
    indexed = saved(classes(vectors, key, vector, neighbours), "vectors")
    asked = vectors.filter(queries & usable(F.col(vector)) & F.col(key).isNotNull())
    asked = asked.select(F.col(key).cast("long").alias("query_id"), F.xxhash64(F.col(vector).cast("array<double>")).alias("ask")).distinct()
    asked = saved(asked, "queries")
    rows = indexed.count()
    forest = grown(indexed, rows)
    if forest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(forest)
    width = forest.normals.shape[1]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            points = _matrix(batch.column(1), width, np.float32)
            for root in trees.roots:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.leaf_of(points, root))], ["code", "leaf"])

    places = saved(indexed.select("code", "vector").mapInArrow(index, "code long, leaf long"), "leaves")
    # As many rows as the forest has leaves, which the sample bounds.
    counted = places.groupBy("leaf").agg(F.count("*").alias("n")).toArrow()
    sizes = np.zeros(1 - int(forest.children.min(initial=-1)), np.int64)
    sizes[-counted.column("leaf").to_numpy()] = counted.column("n").to_numpy()
    search_rows = enough_rows(forest, sizes, indexed, places, asked, neighbours, search_factor * rows**0.5)
    del counted, forest

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            points = _matrix(batch.column(1), width, np.float32)
            found = [trees.search(p, sizes, search_rows) for p in points]
            codes = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(np.concatenate(found))], ["ask", "leaf"])

    points = asked.select("ask").distinct().join(indexed.select(F.col("code").alias("ask"), "vector"), "ask")
    # The walk is work for each query, so queries are dealt out to tasks anew.
    points = saved(points.repartition(spark.sparkContext.defaultParallelism, "ask"), "points")
    # By hash, so blocks differ in size; on average they are half of what is sent at most.
    blocks = max(1, -(-2 * points.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("ask"), F.lit(blocks)).cast("int").alias("block")
    # A leaf's queries come as one list for a block of them, and meet its members as such: as many rows as the index has, for a
    # block, and not one for each query and member.
    visits = points.mapInArrow(search, "ask long, leaf long").withColumn("block", block)
    visits = visits.groupBy("leaf", "block").agg(F.collect_list("ask").alias("asks"))
    met = visits.join(places, "leaf").groupBy("code", "block").agg(F.array_distinct(F.flatten(F.collect_list("asks"))).alias("asks"))
    met = met.join(indexed.select("code", "vector", F.col("ids")[0].alias("least")), "code")
    # Queries and the vectors that they met come together by block, spread over some cells to which all its queries go.
    every = F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1)))
    some = points.select(
        F.lit(0).alias("is_vector"), "ask", F.lit(0).cast("long").alias("least"), "vector", F.array().cast("array<long>").alias("asks"),
        block, every.alias("salt"),
    )
    own = F.pmod(F.xxhash64("code"), F.lit(CELLS)).cast("int").alias("salt")
    rows = some.union(met.select(F.lit(1), "code", "least", "vector", "asks", "block", own))
    rows = rows.repartition("block", "salt").sortWithinPartitions("block", "salt", "is_vector")
    scores = rows.mapInArrow(_reranked(width, neighbours + 2), "ask long, code long, least long, score double")
    order = Window.partitionBy("ask").orderBy("score", "least")
    best = scores.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= neighbours + 2)
    best = best.join(indexed.select("code", "ids"), "code")
    answers = asked.join(best, "ask").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("query_id != vec_id")
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    answers = answers.withColumn("rank", F.row_number().over(rank).cast("int")).filter(F.col("rank") <= neighbours)
    return answers.select("query_id", "rank", "vec_id", "score")
