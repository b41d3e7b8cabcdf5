"""Language-model scoring with Elias-Fano n-gram tries.

The model is a bigram model with a Dirichlet prior: the chance of a token after a context is
(pair count + prior * chance of the token) / (context count + prior), and the chance of a token is its base chance. The
logarithm parts into a term of the pair and its token and a term of the context, so one exchange is enough: all
pairs of one token meet in one shard, whatever their context, and each shard returns sums by document.

A shard is a trie of two levels, tokens and, under each token, the contexts that it followed. Both levels are Elias-Fano
sequences; contexts are numbered relative to their token, so a context is found by successor search in its token's
range. Pointers from the first level to the second are a third such sequence, and the smoothed probabilities of the
pairs are quantised to a byte. The levels lie in one file that is mapped into memory.

Shards are as many as keep each to a bounded number of pairs. Tokens so frequent that they would fill a shard are dealt out by
their context; their counts, at most a few for each shard, are known to all tasks.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator
from math import ceil, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketboard.llm.common import saved, slices

#: Strength of the prior, in tokens.
PRIOR = 200.0
#: Tokens of the corpus for each shard, about.
SHARD_TOKENS = 2_000_000
#: Steps of a quantised base-10 logarithm; a pair was seen once at least, so none is below zero. The highest is that of ten
#: decades, or of the whole corpus if that has more tokens, so no count is clipped.
LEVELS = 255
HIGHEST = 10.0
KEY_BITS = 40
#: Bits that tell contexts apart within one unit: an unseen context passes for a seen one once in 2 ** UNIT_BITS.
UNIT_BITS = 24
#: Text that a task packs at once.
SLICE_BYTES = 6 << 20

#: Tokens no text can have: the end of a text and what stands before its first token.
END, START = "\n".encode(), "\r".encode()
_HASH_END, _HASH_START = (xxhash.xxh64_intdigest(t) for t in (END, START))


# ---- Elias-Fano ------------------------------------------------------------------------------


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, with counts of ones sampled for selection.

    It is built from an array or mapped from the bytes that to_bytes gives.
    """

    SAMPLE = 64

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        counts = np.bitwise_count(high)
        self.ranks = np.append(0, np.cumsum(counts, dtype=np.int64))

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = min(60, max(0, (top // max(n, 1)).bit_length() - 1))
        high = np.zeros(((n + (top >> low_bits) + 64) >> 6) + 1, np.uint64)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        np.bitwise_or.at(high, ones >> 6, np.uint64(1) << (ones & 63).astype(np.uint64))
        low = np.zeros(((n * low_bits + 63) >> 6) + 1, np.uint64)
        if low_bits:
            rest = values & np.uint64((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.int64) * low_bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, rest << shift)
            over = np.flatnonzero((at & 63) + low_bits > 64)
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (np.uint64(64) - shift[over]))
        return cls(n, low_bits, low, high)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        first = self.low[word] >> shift
        second = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (first | second) & np.uint64((1 << self.low_bits) - 1)

    def _select(self, bits: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) one in each word of bits."""
        place = np.zeros(len(k), np.int64)
        bits, k = bits.copy(), k.copy()
        for half in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            up = k >= count
            k -= np.where(up, count, 0)
            place += np.where(up, half, 0)
            bits = np.where(up, bits >> np.uint64(half), bits)
        return place

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        word = np.searchsorted(self.ranks, i, "right") - 1
        one = (word << 6) + self._select(self.high[word], i - self.ranks[word])
        return ((one - i).astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(i)

    def _bucket(self, high: np.ndarray) -> np.ndarray:
        """How many values have a high part below this: the ones before the zero that ends the one before."""
        # Zeros before word w: 64 * w - ranks[w], which never falls.
        zeros = np.arange(len(self.ranks), dtype=np.int64) * 64 - self.ranks
        word = np.searchsorted(zeros, high, "left") - 1
        inside = self._select(~self.high[np.maximum(word, 0)], high - 1 - zeros[np.maximum(word, 0)])
        place = (np.maximum(word, 0) << 6) + inside
        return np.where(high > 0, place - (high - 1), 0)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of the wanted values, the first of equal ones; -1 where the successor is another value."""
        found = np.full(len(wanted), -1, np.int64)
        if not self.n:
            return found
        high = (wanted >> np.uint64(self.low_bits)).astype(np.int64)
        low = wanted & np.uint64((1 << self.low_bits) - 1) if self.low_bits else np.zeros(len(wanted), np.uint64)
        inside = np.flatnonzero(high < (len(self.high) << 6) - self.n)
        begin, end = self._bucket(high[inside]), self._bucket(high[inside] + 1)
        step = 0
        active = np.flatnonzero(begin < end)
        while len(active):
            at = begin[active] + step
            equal = self.lows(at) == low[inside[active]]
            found[inside[active[equal]]] = at[equal]
            step += 1
            active = active[~equal & (begin[active] + step < end[active])]
        return found

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], np.int64)
        return head.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def mapped(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b = np.frombuffer(data, np.int64, 4, at).tolist()
        at += 32
        made = cls(n, low_bits, np.frombuffer(data, np.uint64, a, at), np.frombuffer(data, np.uint64, b, at + 8 * a))
        return made, at + 8 * (a + b)


def quantised(logs: np.ndarray, highest: float) -> np.ndarray:
    """Logarithms from 0 to the highest as steps."""
    if len(logs) and logs.max() > highest:
        raise ValueError("a pair was counted more often than the corpus has tokens")
    return np.rint(np.maximum(logs, 0.0) / highest * LEVELS).astype(np.uint8)


def restored(codes: np.ndarray, highest: float) -> np.ndarray:
    return codes * (highest / LEVELS)


def spread_key(number: int) -> int:
    """A negative key for the exchange, as evenly spread over its partitions as hashes are."""
    return -1 - xxhash.xxh32_intdigest(number.to_bytes(8, "little")) % (1 << 30)


def relative(begin: np.ndarray, size: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Contexts as numbers relative to their token: spread evenly over as many units as the token has contexts, after the
    units of the tokens before it. So the sequence is monotone and dense everywhere, however many contexts a token has."""
    within = (context * size.astype(np.uint64)) >> np.uint64(KEY_BITS - UNIT_BITS)
    return (begin.astype(np.uint64) << np.uint64(UNIT_BITS)) + within


class Trie:
    """tokens (hashes), counts, pointers to their contexts, contexts relative to their token, quantised pair terms and their highest."""

    def __init__(self, tokens: EliasFano, counts: np.ndarray, pointers: EliasFano, contexts: EliasFano, codes: np.ndarray, highest: float):
        self.tokens, self.counts, self.pointers, self.contexts, self.codes, self.highest = tokens, counts, pointers, contexts, codes, highest

    @staticmethod
    def built(token: np.ndarray, context: np.ndarray, n: np.ndarray, chance_of, prior: float, counts: dict[int, int], highest: float) -> bytes:
        """The bytes of a trie of distinct pairs in order of token, then context; n: how often each was seen.

        highest: no pair's term is above it. counts: of tokens whose pairs lie in several shards. chance_of: base chance of a count.
        """
        begins = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        tokens = token[begins]
        totals = np.add.reduceat(n, begins) if len(n) else np.zeros(0, np.int64)
        totals = np.array([counts.get(t, c) for t, c in zip(tokens.tolist(), totals.tolist(), strict=True)], np.int64)
        sizes = np.diff(np.append(begins, len(token)))
        terms = np.log10(n + prior * chance_of(np.repeat(totals, sizes)))
        parts = [EliasFano.of(tokens).to_bytes(), np.array([len(totals)], np.int64).tobytes(), totals.tobytes()]
        parts.append(EliasFano.of(np.append(begins, len(token))).to_bytes())
        parts.append(EliasFano.of(relative(np.repeat(begins, sizes), np.repeat(sizes, sizes), context)).to_bytes())
        codes = quantised(terms, highest)
        parts += [np.array([highest], np.float64).tobytes(), np.array([len(codes)], np.int64).tobytes(), codes.tobytes()]
        return b"".join(parts)

    @classmethod
    def mapped(cls, data: memoryview) -> Trie:
        tokens, at = EliasFano.mapped(data, 0)
        n = int(np.frombuffer(data, np.int64, 1, at)[0])
        counts = np.frombuffer(data, np.int64, n, at + 8)
        pointers, at = EliasFano.mapped(data, at + 8 + 8 * n)
        contexts, at = EliasFano.mapped(data, at)
        highest = float(np.frombuffer(data, np.float64, 1, at)[0])
        m = int(np.frombuffer(data, np.int64, 1, at + 8)[0])
        return cls(tokens, counts, pointers, contexts, np.frombuffer(data, np.uint8, m, at + 16), highest)

    def places(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of tokens (-1: not in the trie) and their counts."""
        at = self.tokens.find(token)
        if not len(self.counts):
            return at, np.zeros(len(token), np.int64)
        return at, np.where(at >= 0, self.counts[np.maximum(at, 0)], 0)

    def terms(self, place: np.ndarray, run: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs the trie has, and their terms. place: of tokens; run: which of these tokens each context goes with."""
        begin, end = (self.pointers.access(np.maximum(place, 0) + i).astype(np.int64) for i in (0, 1))
        known = np.flatnonzero(place[run] >= 0)
        run = run[known]
        pair = self.contexts.find(relative(begin[run], (end - begin)[run], context[known]))
        there = pair >= 0
        return known[there], restored(self.codes[pair[there]], self.highest)

    def followers(self, token: int) -> int:
        """In how many contexts a token was seen."""
        at = self.tokens.find(np.array([token], np.uint64))
        if at[0] < 0:
            return 0
        ends = self.pointers.access(at + np.array([0, 1]))
        return int(ends[1] - ends[0])


# ---- texts to packed pairs ---------------------------------------------------------------------


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens, the tokens of all texts as numbers into them, and tokens of each text."""
    place = _Numbers()
    place[END] = 0
    rows, sizes = [], []
    for text in texts:
        row = list(map(place.__getitem__, text.lower().split()))
        row.append(0)
        rows.append(np.array(row, np.int64))
        sizes.append(len(row))
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in place], np.uint64)
    return hashes, np.concatenate(rows) if rows else np.zeros(0, np.int64), np.array(sizes, np.int64)


def shard_of(token: np.ndarray, context: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    mixed = np.where(np.isin(token, hot), token ^ (context * np.uint64(0x9E3779B97F4A7C15)), token)
    return ((mixed ^ (mixed >> np.uint64(33))) % np.uint64(shards)).astype(np.int64)


def packed(token: np.ndarray, context: np.ndarray, doc: np.ndarray, n: np.ndarray, train: np.ndarray) -> bytes:
    """Rows in order of token, then context: each token once, contexts in KEY_BITS bits, small numbers in few bytes."""
    begins = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, len(token)))
    wide = np.uint32 if len(doc) and doc.max() > 65535 else np.uint16
    many = np.uint32 if len(n) and n.max() > 255 else np.uint8
    planes = context.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]
    head = np.array([len(begins), len(token), np.dtype(wide).itemsize, np.dtype(many).itemsize, len(train)], np.int64)
    parts = [head, token[begins], sizes.astype(np.uint32), planes, doc.astype(wide), n.astype(many), np.packbits(train)]
    return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


def unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    """The tokens and their rows' number, context, doc, n of the rows, and whether each document is learnt from."""
    runs, rows, wide, many, docs = np.frombuffer(data, np.int64, 5).tolist()
    at = 40
    tokens = np.frombuffer(data, np.uint64, runs, at)
    sizes = np.frombuffer(data, np.uint32, runs, at + 8 * runs)
    at += 12 * runs
    width = KEY_BITS // 8
    context = np.zeros((rows, 8), np.uint8)
    context[:, :width] = np.frombuffer(data, np.uint8, rows * width, at).reshape(-1, width)
    at += rows * width
    doc = np.frombuffer(data, np.dtype(f"u{wide}"), rows, at).astype(np.int64)
    at += rows * wide
    n = np.frombuffer(data, np.dtype(f"u{many}"), rows, at).astype(np.int64)
    at += rows * many
    train = np.unpackbits(np.frombuffer(data, np.uint8, -1, at), count=docs).astype(bool)
    return tokens, sizes, context.reshape(-1).view("<u8"), doc, n, train


def token_counts(texts: DataFrame) -> DataFrame:
    """token (hash), n: counts in a column of texts as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for begin, end in slices(rows, SLICE_BYTES):
                hashes, flat, _ = token_hashes(rows[begin:end])
                n = np.bincount(flat, minlength=len(hashes))
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], ["token", "n"])

    return texts.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def scored(
    documents: DataFrame,
    held_out: Column,
    key: str = "doc_id",
    text: str = "text",
    prior: float = PRIOR,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Scores of every document, one row for each row; the model learns from all documents that are not held out.

    key, held_out, n_tokens (words and the end), n_known (tokens seen in training), train_tokens, base_score and score: the
    log10 probabilities of the text under the base and under the model. Null and empty texts are their end alone. Repeated
    rows and repeated or null keys keep a row each. Without training documents every token has the base chance of an empty
    corpus. No documents: no rows. Other columns are not read.

    Tokens are told apart by 64-bit hashes, contexts of one token by 40 bits of theirs when they are counted; when they are
    looked up, a context passes for another one of the same token once in 2 ** UNIT_BITS.
    """
    rows = documents.select(
        F.col(key).alias("key"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    )
    kind = documents.schema[key].dataType.simpleString()
    counts = saved(token_counts(rows.filter(~F.col("held")).select("text")), "token_counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shards = max(1, ceil(total / shard_tokens))
    # Each of these has a quarter of a shard's tokens at least, so there are four for each shard at most.
    many = counts.filter(F.col("n") > total / (4 * shards)).collect()
    hot_counts = {int(r["token"]) & (1 << 64) - 1: r["n"] for r in many}
    hot = np.array(sorted(hot_counts), np.uint64)
    scale = total + 0.5 * (distinct + 1)
    # A pair's term is log10(its count + prior * chance of its token).
    highest = max(HIGHEST, log10(total + prior + 1))

    def chance_of(count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / scale

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for begin, end in slices(texts, SLICE_BYTES):
                hashes, flat, sizes = token_hashes(texts[begin:end])
                docs = len(sizes)
                held = np.array(batch.column("held").slice(begin, docs).to_pylist(), bool)
                starts = np.cumsum(sizes) - sizes
                # A context of its own number stands before the first token.
                before = np.append(len(hashes), flat[:-1]) if len(flat) else flat
                before[starts] = len(hashes)
                names = np.append(hashes, np.uint64(_HASH_START))
                doc = np.repeat(np.arange(docs), sizes)
                bits = len(names).bit_length()
                cells, n = np.unique((((flat << bits) | before) << docs.bit_length()) | doc, return_counts=True)
                doc = cells & ((1 << docs.bit_length()) - 1)
                pair = cells >> docs.bit_length()
                token, whole = names[pair >> bits], names[pair & ((1 << bits) - 1)]
                shard = shard_of(token, whole, hot, shards)
                short = whole & np.uint64((1 << KEY_BITS) - 1)
                order = np.lexsort((short, token, shard))
                token, short, doc, n, shard = (x[order] for x in (token, short, doc, n, shard))
                there, edges = np.unique(shard, return_index=True)
                edges = np.append(edges, len(shard))
                blobs = [packed(token[a:b], short[a:b], doc[a:b], n[a:b], ~held) for a, b in zip(edges, edges[1:], strict=False)]
                size = len(blobs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(there.astype(np.int32)),
                        pa.array(np.full(size, number, np.int64)),
                        pa.array(blobs, pa.binary()),
                        pa.nulls(size, pa_kind),
                        pa.nulls(size, pa.int32()),
                        pa.nulls(size, pa.bool_()),
                        pa.nulls(size, pa.int64()),
                    ],
                    columns,
                )
                # The documents themselves go through the same exchange, a slice to any of its tasks.
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(docs, spread_key(number), np.int32)),
                        pa.array(np.full(docs, number, np.int64)),
                        pa.nulls(docs, pa.binary()),
                        batch.column("key").slice(begin, docs),
                        pa.array(np.arange(docs, dtype=np.int32)),
                        pa.array(held),
                        pa.array(sizes),
                    ],
                    columns,
                )
                number += docs

    columns = ["shard", "row", "blob", "key", "place", "held", "n_tokens"]
    pa_kind = documents.select(key).limit(0).toArrow().schema.field(0).type
    # Contexts are words and the start, so a word's count as a context is its count; that of the start is the texts'.
    texts_learnt = hot_counts.get(_HASH_END) or _count_of(counts, _HASH_END)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards come one after another; of each, the blobs are kept in a file until all its pairs are counted."""
        current, spool = None, None
        for batch in batches:
            packs = batch.column("blob").is_valid()
            yield batch.filter(pa.compute.invert(packs)).drop_columns(["shard"])
            batch = batch.filter(packs)
            for shard, row, blob in zip(*(batch.column(c) for c in columns[:3]), strict=True):
                if shard.as_py() != current:
                    if spool:
                        yield from spool.answers()
                    current, spool = shard.as_py(), _Spool(chance_of, prior, hot_counts, texts_learnt, highest, pa_kind)
                spool.add(row.as_py(), blob.as_py())
        if spool:
            yield from spool.answers()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices come one after another: their documents, and the sums of each shard for them."""
        current, held = None, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns[1:]), strict=True):
                if row[0] != current:
                    if held:
                        yield held.totals()
                    current, held = row[0], _Slice(pa_kind)
                held.add(*row[1:])
        if held:
            yield held.totals()

    carried = f"row long, blob binary, key {kind}, place int, held boolean, n_tokens long"
    made = rows.mapInArrow(pack, f"shard int, {carried}")
    made = made.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(score, carried)
    # Slices have a bounded size, so all that is said of one meets in a task.
    made = made.repartition("row").sortWithinPartitions("row")
    sums = made.mapInArrow(gathered, f"key {kind}, held boolean, n_tokens long, n_known long, base double, model double")
    return sums.select(
        F.col("key").alias(key),
        F.col("held").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * log10(scale)).alias("base_score"),
        F.col("model").alias("score"),
    )


def _count_of(counts: DataFrame, token: int) -> int:
    signed = token - (1 << 64) if token >> 63 else token
    row = counts.filter(F.col("token") == signed).first()
    return row["n"] if row else 0


class _Slice:
    """The documents of one slice and sums over the shards for them."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.documents, self.sums = kind, [], []

    def add(self, blob: bytes | None, key, place: int | None, held: bool | None, n_tokens: int | None) -> None:
        if blob is None:
            self.documents.append((place, key, held, n_tokens))
            return
        n = len(blob) // SUMS.itemsize
        self.sums.append(np.frombuffer(blob, SUMS, n))

    def totals(self) -> pa.RecordBatch:
        self.documents.sort(key=lambda d: d[0])
        _, keys, held, sizes = zip(*self.documents, strict=True)
        n = len(keys)
        rows = np.concatenate(self.sums) if self.sums else np.zeros(0, SUMS)
        known, base, model = (np.bincount(rows["doc"], rows[c], n) for c in ("known", "base", "model"))
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, self.kind), pa.array(held), pa.array(sizes), pa.array(np.rint(known).astype(np.int64)), pa.array(base), pa.array(model)],
            ["key", "held", "n_tokens", "n_known", "base", "model"],
        )


#: What a shard says of a document.
SUMS = np.dtype([("doc", "<u4"), ("known", "<u4"), ("base", "<f8"), ("model", "<f8")])


class _Spool:
    """One shard: packed pairs go to a file, training pairs are counted, and then all pairs ask the trie built of them."""

    MERGE_ROWS = 4_000_000

    def __init__(self, chance_of, prior: float, hot_counts: dict[int, int], texts_learnt: int, highest: float, kind: pa.DataType):
        self.chance_of, self.prior, self.hot_counts = chance_of, prior, hot_counts
        self.texts_learnt, self.highest, self.kind = texts_learnt, highest, kind
        self.hot = np.array(sorted(hot_counts), np.uint64)
        self.hot_totals = np.array([hot_counts[t] for t in sorted(hot_counts)], np.int64)
        self.file = tempfile.TemporaryFile()
        self.blobs: list[tuple[int, int]] = []
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.waiting_rows = 0

    def add(self, row: int, blob: bytes) -> None:
        self.file.write(blob)
        self.blobs.append((row, len(blob)))
        tokens, sizes, context, doc, n, train = unpacked(blob)
        learnt = train[doc]
        self.waiting.append(_summed(np.repeat(tokens, sizes)[learnt], context[learnt], n[learnt]))
        self.waiting_rows += len(self.waiting[-1][0])
        if self.waiting_rows > self.MERGE_ROWS:
            self._merge()

    def _merge(self) -> None:
        if len(self.waiting) > 1:
            self.waiting = [_counted(*(np.concatenate(x) for x in zip(*self.waiting, strict=True)))]
        # Distinct pairs stay; the next merge waits until as many again have come.
        self.waiting_rows = 0

    def answers(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        with tempfile.TemporaryFile() as levels:
            levels.write(Trie.built(*self.waiting[0], self.chance_of, self.prior, self.hot_counts, self.highest))
            levels.flush()
            self.waiting = []
            data = mmap.mmap(levels.fileno(), 0, access=mmap.ACCESS_READ)
            trie = Trie.mapped(memoryview(data))
            self.file.seek(0)
            for row, size in self.blobs:
                yield self._answer(trie, row, self.file.read(size))
        self.file.close()

    def _answer(self, trie: Trie, row: int, blob: bytes) -> pa.RecordBatch:
        tokens, sizes, context, doc, n, train = unpacked(blob)
        place, count = trie.places(tokens)
        if len(self.hot):
            # Tokens that are dealt out by context have the count of the whole corpus, also where no pair was learnt.
            at = np.minimum(np.searchsorted(self.hot, tokens), len(self.hot) - 1)
            count = np.where(self.hot[at] == tokens, self.hot_totals[at], count)
        unseen = np.log10(self.prior * self.chance_of(count))
        # What each token adds as a context, by its own count, and the start of each text by the number of texts.
        follow = np.log10(np.where(tokens == np.uint64(_HASH_END), self.texts_learnt, count) + self.prior)
        run = np.repeat(np.arange(len(tokens)), sizes)
        term = unseen[run]
        pairs, logs = trie.terms(place, run, context)
        term[pairs] = logs
        term -= follow[run]
        docs = len(train)
        sums = np.zeros(docs, SUMS)
        sums["doc"] = np.arange(docs)
        sums["known"] = np.bincount(doc, n * (count > 0)[run], docs)
        sums["base"] = np.bincount(doc, n * np.log10(count + 0.5)[run], docs)
        sums["model"] = np.bincount(doc, n * term, docs)
        sums = sums[np.bincount(doc, minlength=docs) > 0]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([row]), pa.array([sums.tobytes()], pa.binary()), pa.nulls(1, self.kind), pa.nulls(1, pa.int32()),
                pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()),
            ],
            ["row", "blob", "key", "place", "held", "n_tokens"],
        )


def _counted(token: np.ndarray, context: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, with their sums."""
    order = np.lexsort((context, token))
    return _summed(token[order], context[order], n[order])


def _summed(token: np.ndarray, context: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal neighbours become one pair with their sum."""
    if not len(token):
        return token, context, n
    begins = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (context[1:] != context[:-1])))
    return token[begins], context[begins], np.add.reduceat(n, begins)
