"""Ranked lexical search of many items at once, with what they share computed once.

A document's score for an item is a sum over the item's terms, so sums over terms that several items share serve all of
them. The term sets are mined for such groups: first terms that stand in the same items, then, round by round, pairs of
sums that stand beside each other in several items when all are put in one order. The groups make a graph in which a sum
is that of two smaller ones. Documents are scored in blocks: each sum of the graph is one accumulator over the block's
documents, made once, from which larger sums and in the end the items are put together.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketboard.llm.common import per_text, saved

TOP = 10
#: Bytes of item texts that are searched together, about; more items are searched in blocks.
ITEM_BYTES = 1 << 19
#: Bytes of the accumulators that a task holds.
HELD_BYTES = 48 << 20
#: Letters and digits of ASCII and everything beyond ASCII make terms; A-Z count as a-z.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


@dataclass
class Graph:
    """Symbols are terms, numbered from 0, and behind them sums of two symbols each; items are lists of symbols."""

    terms: int
    sums: list[tuple[int, int]]
    items: list[list[int]]

    def additions(self) -> int:
        """Accumulators that are added to one another for a block of documents."""
        return len(self.sums) + sum(max(0, len(row) - 1) for row in self.items)


def _paired(row: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The row with chosen pairs of neighbours replaced, from the left."""
    out, at = [], 0
    while at < len(row):
        made = pairs.get((row[at], row[at + 1])) if at + 1 < len(row) else None
        out.append(row[at] if made is None else made)
        at += 1 if made is None else 2
    return out


def mined(items: list[list[int]], count: int) -> Graph:
    """The graph of the items' terms, given as numbers below count, repeats included."""
    holders: dict[int, list[tuple[int, int]]] = {}
    for item, row in enumerate(items):
        for term, times in Counter(row).items():
            holders.setdefault(term, []).append((item, times))
    sums: list[tuple[int, int]] = []

    def added(left: int, right: int) -> int:
        sums.append((left, right))
        return count + len(sums) - 1

    # Terms of the same items, equally often in each, are one group; it is only worth a sum if two items have it.
    together: dict[tuple, list[int]] = {}
    for term, where in sorted(holders.items()):
        together.setdefault(tuple(where), []).append(term)
    rows: list[list[int]] = [[] for _ in items]
    for where, group in together.items():
        parts = [reduce(added, group)] if len(where) > 1 or where[0][1] > 1 else group
        for item, times in where:
            rows[item] += parts * times
    while True:
        common = Counter(chain.from_iterable(rows))
        rows = [sorted(row, key=lambda s: (-common[s], s)) for row in rows]
        beside = Counter(chain.from_iterable(zip(row, row[1:], strict=False) for row in rows))
        chosen: dict[tuple[int, int], int] = {}
        taken: set[int] = set()
        for pair, times in sorted(beside.items(), key=lambda x: (-x[1], x[0])):
            # A symbol is in one new pair a round, so all the counted places of a pair are there when it is made.
            if times > 1 and not taken & set(pair):
                taken |= set(pair)
                chosen[pair] = added(*pair)
        if not chosen:
            return Graph(count, sums, rows)
        rows = [_paired(row, chosen) for row in rows]


class _Best:
    """The best documents of every item so far: higher scores first, then smaller ids, rows without an id last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.floor = np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]

    def add(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.floor[:, None])
        new = item, scores[item, at], ids[at], unnamed[at]
        rows = [np.concatenate(x) for x in zip(self.rows, new, strict=True)]
        order = np.lexsort((rows[2], rows[3], -rows[1], rows[0]))
        rows = [x[order] for x in rows]
        place = np.arange(len(order)) - np.searchsorted(rows[0], rows[0])
        last = place == self.top - 1
        # Equal scores stay in, as a smaller id may still come.
        self.floor[rows[0][last]] = rows[1][last]
        self.rows = [x[place < self.top] for x in rows]


def accumulated(graph: Graph, number: np.ndarray, row: np.ndarray, value: np.ndarray, documents: int) -> np.ndarray:
    """Scores by item and document, from values by term number and document row."""
    there, place = np.unique(number, return_inverse=True)
    values = np.zeros((len(there), documents), np.int64)
    values[place, row] = value
    held: list[np.ndarray | None] = [None] * (graph.terms + len(graph.sums))
    for i, term in enumerate(there.tolist()):
        held[term] = values[i]
    for i, (left, right) in enumerate(graph.sums, graph.terms):
        one, two = held[left], held[right]
        # A sum of which one side is nowhere in the block is the other side.
        held[i] = two if one is None else one if two is None else one + two
    scores = np.zeros((len(graph.items), documents), np.int64)
    for i, symbols in enumerate(graph.items):
        for symbol in symbols:
            if held[symbol] is not None:
                scores[i] += held[symbol]
    return scores


def lengths(n: list[int], documents: int, total: int) -> np.ndarray:
    """100 - 75 + 75 * n * documents div total, exactly."""
    return np.array([25 + (75 * x * documents) // total for x in n], np.int64)


def postings(documents: DataFrame, numbers: dict[bytes, int], key: str, text: str) -> DataFrame:
    """key, n, numbers and times: of every text with terms how many it has, and which of the given ones how often."""
    shared = documents.sparkSession.sparkContext.broadcast(numbers)

    def run(texts: list[bytes]) -> dict:
        known = shared.value.get
        n, flat, times, ends = [], [], [], [0]
        for data in texts:
            words = terms(data)
            found = Counter(map(known, words))
            found.pop(None, None)
            n.append(len(words))
            flat += found.keys()
            times += found.values()
            ends.append(len(flat))
        ends = pa.array(ends, pa.int32())
        each = {"numbers": flat, "times": times}
        return {"n": pa.array(n, pa.int64())} | {k: pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for k, v in each.items()}

    return per_text(documents, key, text, "n long, numbers array<int>, times array<int>", run).filter("n > 0")


def document_counts(rows: DataFrame, count: int) -> np.ndarray:
    """The documents that hold each term; every task sends one row for each term that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(count, np.int64)
        for batch in batches:
            met += np.bincount(batch.column(0).flatten().to_numpy(), minlength=count)
        there = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(met[there])], ["number", "n"])

    found = rows.select("numbers").mapInArrow(run, "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(count, np.int64)
    counts[found.column("number").to_numpy()] = found.column("n").to_numpy()
    return counts


def _searched(documents: DataFrame, items: pa.Table, key: str, text: str, top: int) -> DataFrame | None:
    """item, item_id, doc_id, score: each task's best documents for the items; None if nothing can be found."""
    spark = documents.sparkSession
    split = [terms((t or "").encode()) for t in items.column("text").to_pylist()]
    numbers = {term: i for i, term in enumerate(sorted(set(chain.from_iterable(split))))}
    if not numbers:
        return None
    graph = mined([[numbers[t] for t in row] for row in split], len(numbers))
    rows = saved(postings(documents, numbers, key, text), "postings")
    total = rows.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    if not total["documents"]:
        return None
    n, length = total["documents"], total["terms"]
    counts = document_counts(rows, len(numbers))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in counts.tolist()], np.int64)
    shared = spark.sparkContext.broadcast((graph, weights, items.column("item_id").combine_chunks()))
    block = max(1, HELD_BYTES // 8 // (len(numbers) + len(graph.sums) + len(graph.items)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, weights, names = shared.value
        best = _Best(len(graph.items), top)
        for whole in batches:
            for begin in range(0, len(whole), block):
                batch = whole.slice(begin, block)
                ids = batch.column(0)
                m = lengths(batch.column(1).to_pylist(), n, length)
                sizes = batch.column(2).value_lengths().to_numpy()
                number, times = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
                row = np.repeat(np.arange(len(batch)), sizes)
                value = weights[number] * ((1_000_000_000 * times) // (1000 * times + 8 * m[row]))
                scores = accumulated(graph, number, row, value, len(batch))
                best.add(scores, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        item, score, key_, null = best.rows
        found = pa.array(key_, mask=null)
        yield pa.RecordBatch.from_arrays([pa.array(item), names.take(pa.array(item)), found, pa.array(score)], ["item", "item_id", "doc_id", "score"])

    kind = items.schema.field("item_id").type
    source = rows.select(F.col(key).cast("long").alias("doc_id"), "n", "numbers", "times")
    return source.mapInArrow(run, f"item long, item_id {'long' if pa.types.is_integer(kind) else 'string'}, doc_id long, score long")


def ranked(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id, score: the documents with the highest scores above 0 for every item.

    Equal scores rank by ascending id, documents without an id last. Null texts have no terms: such documents do not count,
    such items find nothing. Repeated documents are documents each; items alike in id and text are one, of which equal
    ids with other texts are told apart by their rows only. Texts are taken whole. No documents or no items: no rows.
    Ids are whole numbers; items may have texts as ids.
    """
    kind = "string" if items.schema[item_key].dataType.simpleString() == "string" else "long"
    asked = items.select(F.col(item_key).cast(kind).alias("item_id"), F.col(item_text).alias("text")).distinct()
    asked = saved(asked, "items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // item_bytes))
    made = []
    for number in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).orderBy("item_id", "text").toArrow()
        found = _searched(documents, some, key, text, top)
        if found is not None:
            order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
            found = found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= top)
            found = found.select("item_id", "rank", "doc_id", "score")
            made.append(saved(found, "ranked") if blocks > 1 else found)
    if not made:
        return documents.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.union, made)


def oracle(top: int = TOP) -> str:
    """DuckDB SQL for the rows of ranked."""
    found = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
with d as materialized (
  select row_number() over () as r, doc_id, {found.format("text")} as t from documents where text is not null
), n as (
  select count(*)::bigint as docs, sum(len(t))::bigint as total from d where len(t) > 0
), p as materialized (
  select r, doc_id, n, term, count(*)::bigint as tf from (select r, doc_id, len(t)::bigint as n, unnest(t) as term from d) group by all
), w as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w
  from (select term, count(*) as df from p group by term), n
), i as (
  select item_id, text, term, count(*)::bigint as times
  from (select distinct item_id, text, unnest({found.format("text")}) as term, generate_subscripts({found.format("text")}, 1) as at from benchmark)
  group by all
), s as (
  select item_id, text, r, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * docs) // total))))::bigint as score
  from i join p using (term) join w using (term), n group by all
)
select item_id, rank::int as rank, doc_id, score from (
  select *, row_number() over (partition by item_id, text order by score desc, doc_id) as rank from s where score > 0
) where rank <= {top}
"""
