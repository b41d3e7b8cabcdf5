"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are computed from all shingles of a text. Equal fingerprints form one class. Classes at a small Hamming
distance are found by parts: bits that go together are put into one part, and dynamic programming gives every
part its own radius, so that two fingerprints within the threshold agree within the radius in one part at least. The
radii sum to the threshold less the number of parts less one; a part with radius -1 is not searched. Costs
come from candidate counts estimated from the bits of all classes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketboard.llm.common import appended, fresh, per_text, saved
from marketboard.llm.connected import components

BITS = 64
SEED = 42
SHINGLE_WORDS = 5
MAX_PARTS = 6
#: Work of one probe row against one candidate that is verified in place.
PROBE_COST = 3.0
#: Larger buckets are linked through common neighbours in place of pairs.
BUCKET_ROWS = 64
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15

# ---- near copies: more words find candidates, shingles decide ------------------------------------
WORDS = 24
#: As a fraction, so that a similarity of just so much counts.
SIMILARITY = (4, 5)
#: Parts of a word, of 16 bits each, all searched at every input size: no pair within a distance of 3 in one word escapes. A pair at
#: a similarity of 0.8 agrees in one of the 96 parts with a chance of 99.8 in 100 (measured on 5000 pairs).
WORD_PARTS = 4
#: Every part has so many keys, so the buckets of all parts can be counted in one array of the same size for any input.
KEYS = 1 << (BITS // WORD_PARTS)
#: A bucket's number: its place among all keys of all parts, then the two blocks of its rows that meet.
BLOCK_BITS = 20
#: Bits of a word differ with a chance of 0.151 at a similarity of 0.8. Candidates lie within the mean and 3.6 standard
#: deviations or more: of two words where a bucket's rows meet, of all words after that.
MEETING_WORDS, MEETING_DISTANCE = 2, 36
CANDIDATE_DISTANCE = 283
#: Larger buckets of the first words elect a leader, whose copies are linked first.
LEADER_ROWS, LEADER_WORDS = 8, 8
#: Larger buckets are compared on all words, in blocks of so many rows.
CROWD_ROWS, BLOCK_ROWS = 64, 512
#: Fingerprints whose places are found at once, and rows that are handed on at once.
FOUND_ROWS, HANDED_ROWS = 1 << 12, 1 << 16
#: Counts that travel as one row.
COUNTED = 1 << 12
#: Words whose crowded buckets are linked before those of all words.
CROWD_WAVES = (1, 4)
#: Cells of marks that travel to all tasks at most; beyond so many texts they sort out ever fewer.
MARK_CELLS = 1 << 20
#: Pairs of a bucket's rows that are compared at once.
MET_PAIRS = 1 << 18


def shingle_hashes(text: bytes, shingle_words: int) -> np.ndarray:
    """The hash of every shingle, repeats included; A-Z is lower-cased. Fewer words: one shingle; none: empty."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    starts = [0, *accumulate(len(w) + 1 for w in tokens)]
    span = min(shingle_words, len(tokens))
    hashed = xxhash.xxh64_intdigest
    bounds = zip(starts[: len(tokens) - span + 1], starts[span:], strict=True)
    return np.fromiter((hashed(joined[a : b - 1], SEED) for a, b in bounds), np.uint64, len(tokens) - span + 1)


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """Signed 64-bit words; a bit is set if it is set in more than half of the hashes. No hashes: zeros.

    The first word is that of the hashes themselves, the others are of the hashes mixed again.
    """
    made = []
    for word in range(words):
        counts = np.zeros(BITS, np.int64)
        for begin in range(0, len(hashes), BLOCK):
            block = hashes[begin : begin + BLOCK]
            of_word = (mixed(block, word) if word else block).astype("<u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(of_word, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        made.append(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8"))
    return np.concatenate(made).astype(np.int64)


def wide_fingerprint(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The same as fingerprint, all words at once."""
    counts = np.zeros(words * BITS, np.int64)
    numbers = np.arange(words)
    # Blocks so short that counts fit a byte.
    for begin in range(0, len(hashes), 255):
        block = hashes[begin : begin + 255, None]
        every = np.where(numbers, mixed(block, numbers.astype(np.uint64)), block).astype("<u8")
        bits = np.unpackbits(every.view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8").astype(np.int64)


def mixed(hashes: np.ndarray, word: int | np.ndarray) -> np.ndarray:
    """Other well-spread 64-bit numbers, one for each word number (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(0x9E3779B97F4A7C15) * np.asarray(word, np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(
    documents: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, words: int = 1
) -> DataFrame:
    """key, node, fp (array of 64-bit words) of every document; the text is lower-cased in A-Z only.

    node is the only word, or a hash of all of them.
    """

    def run(texts: list[bytes]) -> dict:
        rows = [fingerprint(shingle_hashes(t, shingle_words), words) for t in texts]
        flat = pa.array(np.concatenate(rows))
        return {"fp": pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, words, dtype=np.int32), flat)}

    made = per_text(documents, key, text, "fp array<long>", run)
    return made.select(key, node_of("fp", words).alias("node"), "fp")


def node_of(fp: str, words: int) -> Column:
    return F.col(fp)[0] if words == 1 else F.xxhash64(fp)


def bit_counts(classes: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """How often two bits of a word are set together (words x 64 x 64), over all classes, and the number of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((words, BITS, BITS), np.int64), 0
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(-1, words)
            for word in range(words):
                bytes_of = np.ascontiguousarray(values[:, word]).view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(bytes_of, axis=1, bitorder="little").astype(np.float32)
                total[word] += (bits.T @ bits).astype(np.int64)
            n += len(values)
        if n:
            flat = np.append(total.ravel(), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(flat.size)), pa.array(flat)], ["cell", "n"])

    cells = classes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    flat = np.zeros(words * BITS * BITS + 1, np.int64)
    got = cells.toArrow()
    flat[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return flat[:-1].reshape(words, BITS, BITS), int(flat[-1])


def correlated_parts(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits dealt to parts of even width; each part grows by the bit most correlated with those it has."""
    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    bond = np.abs(together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(bond, 0)
    left, made = set(range(BITS)), []
    for part in range(parts):
        width = len(left) // (parts - part)
        first = max(left, key=lambda b: (bond[b, sorted(left)].sum(), -b))
        chosen = [first]
        left.discard(first)
        while len(chosen) < width:
            best = max(left, key=lambda b: (bond[b, chosen].sum(), -b))
            chosen.append(best)
            left.discard(best)
        made.append(sorted(chosen))
    return made


def distance_chances(bits: list[int], share: np.ndarray) -> np.ndarray:
    """Probability of each distance of two fingerprints within a part, its bits taken as independent."""
    chance = np.array([1.0])
    for b in bits:
        differ = 2 * share[b] * (1 - share[b])
        chance = np.append(chance * (1 - differ), 0) + np.append(0, chance * differ)
    return chance


def allocation(parts: list[list[int]], share: np.ndarray, n: int, distance: int) -> tuple[float, list[int]]:
    """The cheapest radii of the parts (-1: not searched) and their estimated cost."""
    best = {0: (0.0, [])}
    for bits in parts:
        chance = np.cumsum(distance_chances(bits, share))
        costs = [0.0]
        for radius in range(min(distance, len(bits)) + 1):
            probes = sum(comb(len(bits), i) for i in range(radius + 1))
            costs.append(n * probes * PROBE_COST + n * n * chance[radius])
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, radii) in best.items():
            for units, more in enumerate(costs):
                if used + units <= distance + 1:
                    choice = (cost + more, [*radii, units - 1])
                    following[used + units] = min(following.get(used + units, choice), choice)
        best = following
    return best[distance + 1] if distance + 1 in best else (float("inf"), [])


def search_plan(classes: DataFrame, words: int, distance: int) -> list[tuple[int, list[int], int]]:
    """(word, bits, radius) of every part that is searched; distance: within each word."""
    chosen = []
    counted, n = bit_counts(classes, words)
    for word, together in enumerate(counted):
        share = np.diag(together) / max(n, 1)
        plans = []
        for parts in range(1, MAX_PARTS + 1):
            bits = correlated_parts(together, n, parts)
            cost, radii = allocation(bits, share, n, distance)
            plans.append((cost, parts, [(word, b, r) for b, r in zip(bits, radii, strict=False) if r >= 0]))
        chosen += min(plans)[2]
    return chosen


def word_plan(counted: np.ndarray, n: int) -> list[tuple[int, list[int], int]]:
    """(word, bits, 0) of WORD_PARTS parts of every word: so many at every n, so that recall does not depend on it."""
    return [(word, bits, 0) for word, together in enumerate(counted) for bits in correlated_parts(together, n, WORD_PARTS)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _flips(bits: list[int], radius: int) -> list[int]:
    """Differences of at most so many of the bits."""
    return [_mask(list(c)) for r in range(radius + 1) for c in combinations(bits, r)]


def _parts(classes: DataFrame, plan: list[tuple[int, list[int], int]], probes: bool) -> DataFrame:
    """node, fp, part, key: a row for each part, or one for each key of the part within its radius."""
    rows = []
    for i, (word, bits, radius) in enumerate(plan):
        key = F.col("fp")[word].bitwiseAND(F.lit(_mask(bits)))
        keys = F.array(key)
        if probes and radius:
            keys = F.transform(F.array(*[F.lit(x) for x in _flips(bits, radius)]), lambda x, key=key: key.bitwiseXOR(x))
        rows.append(F.transform(keys, lambda x, i=i: F.struct(F.lit(i).alias("part"), x.alias("key"))))
    return classes.select("node", "fp", F.explode(F.concat(*rows)).alias("at")).select("node", "fp", "at.*")


def _close(a: str, b: str, words: int, distance: int) -> Column:
    apart = [F.bit_count(F.col(a)[w].bitwiseXOR(F.col(b)[w])) for w in range(words)]
    return sum(apart[1:], apart[0]) <= distance


def _crowded(index: DataFrame, rows: int = BUCKET_ROWS) -> DataFrame:
    return index.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > rows).select("part", "key")


def _met(probes: DataFrame, index: DataFrame, words: int, distance: int) -> DataFrame:
    """u, v: verified pairs of probes and members of one bucket."""
    asked = probes.select(F.col("node").alias("u"), F.col("fp").alias("asked"), "part", "key")
    met = asked.join(index, ["part", "key"]).filter(_close("asked", "fp", words, distance) & (F.col("u") != F.col("node")))
    return met.select("u", F.col("node").alias("v"))


def exact_links(classes: DataFrame, distance: int = 2) -> DataFrame:
    """u, v: pairs of one-word fingerprints within a distance of 2 (or 0) that connect all classes which such pairs connect.

    classes: a saved table with one row for each fingerprint. In a bucket of bounded size every pair is verified. The
    members of larger buckets, and all that probe these, meet through neighbours: two fingerprints are within two bits
    exactly if some number is within one bit of both. Each is linked to the smallest fingerprint around each such
    number: linear work, no pairs, no link lost.
    """
    if distance not in (0, 2):
        raise ValueError("neighbours prove a distance of 0 or 2 only")
    plan = search_plan(classes, 1, distance)
    index = saved(_parts(classes, plan, False), "index")
    crowded = saved(_crowded(index), "crowded")
    probes = _parts(classes, plan, True)
    pairs = _met(probes, index.join(crowded, ["part", "key"], "left_anti"), 1, distance)
    if crowded.isEmpty():
        return pairs
    near = probes.join(crowded, ["part", "key"], "left_semi").select("node").distinct()
    around = F.array(*[F.lit(x) for x in _flips(list(range(BITS)), distance // 2)])
    spots = near.select("node", F.explode(F.transform(around, lambda x: F.col("node").bitwiseXOR(x))).alias("spot"))
    least = spots.groupBy("spot").agg(F.min("node").alias("v"), F.max("node").alias("most")).filter("v < most")
    return pairs.union(spots.join(least.select("spot", "v"), "spot").filter("node > v").select(F.col("node").alias("u"), "v"))


def _places(fp: np.ndarray, plan: list[tuple[int, list[int], int]]) -> np.ndarray:
    """The place of every fingerprint's key in every part (rows x parts), keys of one part after those of another."""
    order = np.array([word * BITS + b for word, bits, _ in plan for b in bits])
    bits = np.unpackbits(np.ascontiguousarray(fp).astype("<i8").view(np.uint8), axis=1, bitorder="little")
    keys = np.packbits(np.take(bits, order, axis=1), axis=1, bitorder="little")
    keys = np.ascontiguousarray(keys).view("<u2")
    return keys + np.arange(len(plan)) * KEYS


def _prints_of(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with their fingerprints as an array."""
    for begin in range(0, len(batch), FOUND_ROWS):
        part = batch.slice(begin, FOUND_ROWS)
        yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def place_counts(classes: DataFrame, plan: list[tuple[int, list[int], int]]) -> np.ndarray:
    """How many classes have each place. The array has KEYS numbers for each part, whatever the input's size.

    A task adds up its classes in such an array and passes it on in compressed blocks, so that no row is made for a class and bucket.
    """
    size = len(plan) * KEYS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for batch in batches:
            for _, fp in _prints_of(batch, "fp"):
                np.add.at(total, _places(fp, plan).ravel(), 1)
        blocks = total.reshape(-1, COUNTED)
        some = np.flatnonzero(blocks.any(axis=1))
        packed = [zlib.compress(blocks[i].astype("<u4").tobytes(), 1) for i in some]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(packed, pa.binary())], ["block", "packed"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(zlib.decompress(packed), "<u4")
        packed = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(packed, pa.binary())], ["block", "packed"])

    kind = "block long, packed binary"
    got = classes.select("fp").mapInArrow(count, kind).repartition("block").mapInArrow(add, kind).toArrow()
    total = np.zeros(size, np.uint32)
    for block, packed in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
        total[block * COUNTED : (block + 1) * COUNTED] = np.frombuffer(zlib.decompress(packed), "<u4")
    return total


def _bucket_rows(members: DataFrame, plan: list[tuple[int, list[int], int]], chosen: np.ndarray, words: int) -> DataFrame:
    """bucket, root, node and the first words of each member (root, node, fp) for each of its chosen places.

    The array of chosen places has the size of place_counts and travels to the tasks.
    """
    shared = members.sparkSession.sparkContext.broadcast(chosen)
    names = [f"w{i}" for i in range(words)]

    def rows_of(part: pa.RecordBatch, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        root, node = (part.column(i).to_numpy() for i in range(2))
        places = _places(fp, plan).ravel()
        at = np.flatnonzero(shared.value[places])
        for begin in range(0, len(at), HANDED_ROWS):
            some = at[begin : begin + HANDED_ROWS]
            row, bucket = some // len(plan), places[some] << 2 * BLOCK_BITS
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, root[row], node[row], *fp[row, :words].T)], ["bucket", "root", "node", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, fp in _prints_of(batch, "fp"):
                yield from rows_of(part, fp)

    kinds = ", ".join(f"{n} long" for n in ("bucket", "root", "node", *names))
    return members.select("root", "node", "fp").mapInArrow(run, kinds)


def _crowd_rows(members: DataFrame, plan: list[tuple[int, list[int], int]], crowds: np.ndarray) -> DataFrame:
    """bucket, root, node and all words of each member (root, node, fp) for each of its crowded places, in cells of two blocks.

    crowds: ascending places, the largest group (root) of each, and the blocks into which its rows and those of all others
    fall. Rows of the largest group meet the others alone, so each of them goes to as many cells as the others have blocks: a
    group of copies with a few strangers in its buckets costs its members, however large it is. The others also meet each
    other. The array travels to the tasks.
    """
    shared = members.sparkSession.sparkContext.broadcast(crowds)
    names = [f"w{i}" for i in range(WORDS)]

    def rows_of(part: pa.RecordBatch, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        crowded, largest, most, rest = shared.value
        root, node = (part.column(i).to_numpy() for i in range(2))
        places = _places(fp, plan).ravel()
        found = np.minimum(np.searchsorted(crowded, places), len(crowded) - 1)
        at = np.flatnonzero(crowded[found] == places)
        found, row = found[at], at // len(plan)
        main = root[row] == largest[found]
        blocks = np.where(main, most[found], rest[found])
        own = (mixed(node[row].view(np.uint64), 1) % blocks.astype(np.uint64)).astype(np.int64) + np.where(main, 0, most[found])
        # the others of one block meet in its cells with the largest group, so they need none of their own
        times = np.where(main, rest[found], most[found] + rest[found] - 1)
        done = np.append(0, np.cumsum(times))
        begin = 0
        while begin < len(at):
            upto = max(begin + 1, int(np.searchsorted(done, done[begin] + HANDED_ROWS, side="right")) - 1)
            each = np.repeat(np.arange(begin, upto), times[begin:upto])
            other = np.arange(len(each)) - (done[each] - done[begin])
            other += np.where(main[each], most[found[each]], other >= own[each])
            bucket = (places[at[each]] << 2 * BLOCK_BITS) + (np.minimum(own[each], other) << BLOCK_BITS) + np.maximum(own[each], other)
            of = row[each]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, root[of], node[of], *fp[of].T)], ["bucket", "root", "node", *names])
            begin = upto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value.size:
                for part, fp in _prints_of(batch, "fp"):
                    yield from rows_of(part, fp)

    kinds = ", ".join(f"{n} long" for n in ("bucket", "root", "node", *names))
    return members.select("root", "node", "fp").mapInArrow(run, kinds)


def _apart(a: list[Column], b: list[Column]) -> Column:
    bits = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)]
    return sum(bits[1:], bits[0])


def _within(pairs: DataFrame, classes: DataFrame, distance: int) -> DataFrame:
    """Those of the pairs u, v whose whole fingerprints are within the distance."""
    one = classes.select(F.col("node").alias("u"), F.col("fp").alias("fp_u"))
    two = classes.select(F.col("node").alias("v"), F.col("fp").alias("fp_v"))
    return pairs.join(one, "u").join(two, "v").filter(_close("fp_u", "fp_v", WORDS, distance)).select("u", "v")


def leader_pairs(classes: DataFrame, plan: list[tuple[int, list[int], int]], counts: np.ndarray) -> DataFrame:
    """u, v: members of larger buckets near the bucket's smallest member, v. One row a member and bucket is joined."""
    words = [f"w{i}" for i in range(MEETING_WORDS)]
    plan = [p for p in plan if p[0] < LEADER_WORDS]
    counts = counts[: len(plan) * KEYS]
    members = classes.select(F.col("node").alias("root"), "node", "fp")
    index = _bucket_rows(members, plan, counts > LEADER_ROWS, MEETING_WORDS).drop("root")
    leaders = index.groupBy("bucket").agg(F.min(F.struct("node", *words)).alias("head"))
    near = _apart([F.col(w) for w in words], [F.col("head")[w] for w in words]) <= MEETING_DISTANCE
    met = index.join(leaders, "bucket").filter(near & (F.col("node") != F.col("head.node")))
    return _within(met.select(F.col("node").alias("u"), F.col("head.node").alias("v")).distinct(), classes, CANDIDATE_DISTANCE)


def _bits_apart(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a), np.int32)
    for word in words:
        total += np.bitwise_count(word[a] ^ word[b])
    return total


def _first_met(words: np.ndarray, a: np.ndarray, b: np.ndarray, part: np.ndarray, masks: list[tuple[int, np.uint64]]) -> np.ndarray:
    """Whether the part in which the pairs meet is the first one that they share."""
    first = np.ones(len(a), bool)
    for i, (word, mask) in enumerate(masks):
        open_ = np.flatnonzero(first & (part > i))
        if len(open_):
            first[open_] = (words[word, a[open_]] ^ words[word, b[open_]]) & mask != 0
    return first


def _pairs_across(rows: np.ndarray, masks: list[tuple[int, np.uint64]] | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bucket and nodes of near rows of different roots; rows: bucket, root, node and words, whole buckets by bucket and root.

    With the masks of all parts, rows have all words: pairs are near as a whole and each is told once, in the first part.
    """
    bucket, root, node = rows[:3]
    part = (bucket >> 2 * BLOCK_BITS) // KEYS
    words, n = rows[3:].view(np.uint64), rows.shape[1]
    other = np.append(True, bucket[1:] != bucket[:-1])

    def ends(starts: np.ndarray) -> np.ndarray:
        at = np.append(np.flatnonzero(starts), n)
        return np.repeat(at[1:], np.diff(at))

    # Each row meets what follows its root's rows in its bucket.
    begins = ends(other | np.append(True, root[1:] != root[:-1]))
    counts = ends(other) - begins
    done, at = np.append(0, np.cumsum(counts)), 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(done, done[at] + MET_PAIRS, side="right")) - 1)
        some = counts[at:upto]
        a = np.repeat(np.arange(at, upto), some)
        b = np.arange(len(a)) - np.repeat(done[at:upto] - done[at], some) + begins[a]
        near = _bits_apart(words[:MEETING_WORDS], a, b) <= MEETING_DISTANCE
        a, b = a[near], b[near]
        if masks:
            near = _bits_apart(words, a, b) <= CANDIDATE_DISTANCE
            a, b = a[near], b[near]
            near = _first_met(words, a, b, part[a], masks)
            a, b = a[near], b[near]
        if len(a):
            yield bucket[a], np.maximum(node[a], node[b]), np.minimum(node[a], node[b])
        at = upto


def _as_pairs(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    for _, one, two in found:
        yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], ["u", "v"])


def _as_met(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """bucket, node: a row for each node that is in a pair of the bucket, so as many as there are members at most."""
    for bucket, one, two in found:
        met = np.unique(np.concatenate([np.stack([bucket, one], 1), np.stack([bucket, two], 1)]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(met[:, i].copy()) for i in range(2)], ["bucket", "node"])


def _as_partners(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """cell, node, partners: a row for each node that is in a pair of the cell, so as many as there are members at most."""
    found = list(found)
    if found:
        cell, one, two = (np.concatenate(x) for x in zip(*found, strict=True))
        ends = np.concatenate([np.stack([cell, one], 1), np.stack([cell, two], 1)])
        nodes, place = np.unique(ends, axis=0, return_inverse=True)
        place = place.ravel()[: len(one)]
        offsets = np.append(0, np.cumsum(np.bincount(place, minlength=len(nodes)))).astype(np.int32)
        partners = pa.ListArray.from_arrays(pa.array(offsets), pa.array(two[np.argsort(place, kind="stable")]))
        columns = [pa.array(nodes[:, 0].copy()), pa.array(nodes[:, 1].copy()), partners]
        yield pa.RecordBatch.from_arrays(columns, ["cell", "node", "partners"])


def _linked(rows: list[tuple[int, list[int], np.ndarray]]) -> list[tuple[int, int]]:
    """Pairs of nodes with similar sets that connect all that such pairs of one cell connect; rows: node, partners, set."""
    sets = {node: members for node, _, members in rows}
    parent = {node: node for node in sets}

    def top(node: int) -> int:
        while parent[node] != node:
            parent[node] = node = parent[parent[node]]
        return node

    links = []
    for node, partners, mine in rows:
        for other in partners:
            if top(node) != top(other):
                common = len(np.intersect1d(mine, sets[other], assume_unique=True))
                if common * SIMILARITY[1] >= (len(mine) + len(sets[other]) - common) * SIMILARITY[0]:
                    parent[top(node)] = top(other)
                    links.append((node, other))
    return links


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task's rows (cell, node, partners, set), which come by cell; a cell may go over several batches."""
    held, cell = [], None
    for batch in batches:
        cells, nodes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        partners, sets = batch.column(2).to_pylist(), batch.column(3)
        begins, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        for i, at in enumerate(cells):
            if at != cell:
                yield _link_rows(held)
                held, cell = [], at
            held.append((nodes[i], partners[i], flat[begins[i] : begins[i + 1]]))
    yield _link_rows(held)


def _link_rows(rows: list[tuple[int, list[int], np.ndarray]]) -> pa.RecordBatch:
    links = _linked(rows)
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], ["u", "v"])


def _across(told: Callable[..., Iterator[pa.RecordBatch]], masks: list[tuple[int, np.uint64]] | None = None):
    """A task's work on rows that come by bucket and root: what is told of their pairs.

    A bucket may go over several batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack([c.to_numpy() for c in batch.columns])
            if held and held[0][0, 0] != rows[0, 0]:
                yield from told(_pairs_across(np.concatenate(held, axis=1), masks))
                held = []
            cut = int(np.append(0, np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1)[-1])
            if cut:
                yield from told(_pairs_across(np.concatenate([*held, rows[:, :cut]], axis=1), masks))
                held = []
            held.append(rows[:, cut:])
        if held:
            yield from told(_pairs_across(np.concatenate(held, axis=1), masks))

    return run


def group_pairs(classes: DataFrame, led: DataFrame, plan: list[tuple[int, list[int], int]]) -> DataFrame:
    """u, v: all near classes of different groups (led: node, root) that share a bucket of any part of any word."""
    counts = place_counts(classes, plan)
    crowds = crowded_partners(classes, led, plan, counts)
    return few_pairs(classes, led, plan, counts).union(crowds.select(F.col("node").alias("u"), F.explode("partners").alias("v"))).distinct()


def _masks(plan: list[tuple[int, list[int], int]]) -> list[tuple[int, np.uint64]]:
    return [(word, np.uint64(_mask(bits) % (1 << BITS))) for word, bits, _ in plan]


def _members(classes: DataFrame, led: DataFrame) -> DataFrame:
    return classes.select("node", "fp").join(led, "node", "left").select(F.coalesce("root", "node").alias("root"), "node", "fp")


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket", "root")


def few_pairs(classes: DataFrame, led: DataFrame, plan: list[tuple[int, list[int], int]], counts: np.ndarray) -> DataFrame:
    """u, v: the pairs of group_pairs from buckets of few rows.

    Rows carry their first words, and of each bucket only those that are near another one in these come to it a second time,
    with all words. No row is made for a pair before it is known to be near as a whole, so a group of rows that are
    near in the first words alone costs its members and not their pairs.
    """
    members = _members(classes, led)
    rows = _bucket_rows(members, plan, (counts > 1) & (counts <= CROWD_ROWS), MEETING_WORDS)
    met = _by_bucket(rows).mapInArrow(_across(_as_met), "bucket long, node long")
    asked = members.join(met.groupBy("node").agg(F.collect_set("bucket").alias("buckets")), "node")
    whole = asked.select(F.explode("buckets").alias("bucket"), "root", "node", *[F.col("fp")[i].alias(f"w{i}") for i in range(WORDS)])
    return _by_bucket(whole).mapInArrow(_across(_as_pairs, _masks(plan)), "u long, v long")


def crowded_partners(classes: DataFrame, led: DataFrame, plan: list[tuple[int, list[int], int]], counts: np.ndarray) -> DataFrame:
    """cell, node, partners: the pairs of group_pairs from crowded buckets.

    No pairs form within a group, so a large group of copies costs its members and not their pairs. Rows of crowded
    buckets, if these have more than one group, carry all words, and each of them lists its partners, near as a whole: the
    comparisons of a cell stay in its task, and it sends a row for each member at most.
    """
    members = _members(classes, led)
    seen = _bucket_rows(members, plan, counts > CROWD_ROWS, 0)
    sizes = seen.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    ends = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("roots"))
    # Places, of which there are so many at most as the array of counts has.
    got = ends.filter("roots > 1").select(F.shiftright("bucket", 2 * BLOCK_BITS).alias("place"), "most.root", "most.n", F.col("n") - F.col("most.n")).toArrow()
    place, root, most, rest = (c.to_numpy().astype(np.int64) for c in got.columns)
    rows = _crowd_rows(members, plan, np.stack([place, root, -(-most // BLOCK_ROWS), -(-rest // BLOCK_ROWS)])[:, np.argsort(place)])
    return _by_bucket(rows).mapInArrow(_across(_as_partners, _masks(plan)), "cell long, node long, partners array<long>")


def grouped(prints: DataFrame, key: str, linker) -> DataFrame:
    """node, component_id, root: the smallest key of the component of every fingerprint."""
    classes = saved(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.min(key).alias("least")), "classes")
    roots = components(linker(classes))
    labelled = classes.select("node", "least").join(roots, "node", "left")
    labelled = saved(labelled.select("node", F.coalesce("root", "node").alias("root"), "least"), "labelled")
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return labelled.join(least, "root").select("node", "component_id", "root")


def near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, distance: int = 2
) -> DataFrame:
    """key, fingerprint (16 hexadecimal digits) and component_id of every document, one row for each row.

    Null and empty texts have fingerprint zero and are linked like others. Texts with fewer words than a shingle are one
    shingle. Repeated rows and repeated or null keys keep a row each; a component of null keys alone has a null id.
    An empty table gives no rows. Columns other than key and text are not read.
    """
    prints = saved(fingerprints(documents, key, text, shingle_words), "prints")
    groups = grouped(prints, key, lambda classes: exact_links(classes, distance))
    out = prints.join(groups, "node")
    return out.select(key, F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


def distinct_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest key (null last), then the smallest text.

    Near: shingles of five words and a similarity of 0.8 or more. Fingerprints of the sets of shingles find the candidates, and
    the sets decide. All columns unchanged. Of equal rows one stays. Texts without words are one group. An empty table gives
    no rows.
    """
    one = fresh(documents, "_node")

    def words_of(texts: list[bytes]) -> dict:
        flat = pa.array(np.concatenate([wide_fingerprint(np.unique(shingle_hashes(t, SHINGLE_WORDS))) for t in texts]))
        return {"fp": pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, WORDS, dtype=np.int32), flat)}

    def shingles_of(texts: list[bytes | None]) -> pa.Array:
        sets = [np.unique(shingle_hashes(t or b"", SHINGLE_WORDS)).view(np.int64) for t in texts]
        ends = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))

    body = F.col(text).cast("binary")
    # A row is known by its key and all of its text; rows that share both are equal for this purpose.
    # Two hashes, as one would give some of many billion rows the same mark.
    mark = F.struct(F.xxhash64(F.col(key), F.col(text)).alias("a"), F.xxhash64(F.lit("second"), F.col(text), F.col(key)).alias("b"))
    prints = per_text(documents, key, text, "fp array<long>", words_of, extra=[mark])
    prints = saved(prints.select(F.col(key).alias("key"), F.col("_extra0").alias("mark"), node_of("fp", WORDS).alias("node"), "fp"), "prints")

    def sets_of(asked: DataFrame) -> DataFrame:
        """node, set: the shingles of one text of each class."""
        # Saved, so that its size is known when the join with all texts is planned.
        chosen = saved(prints.join(asked, "node", "left_semi").groupBy("node").agg(F.min("mark").alias("mark")), "chosen")
        # Cells of marks, of which there are MARK_CELLS at most, keep most texts that are not asked for out of the exchange.
        cell = F.pmod("mark.a", F.lit(MARK_CELLS)).alias("cell")
        texts = documents.select(mark.alias("mark"), body.alias("body")).select("*", cell)
        texts = texts.join(F.broadcast(chosen.select(cell).distinct()), "cell", "left_semi").drop("cell")
        texts = texts.join(chosen, "mark").dropDuplicates(["node"])
        return saved(appended(texts.select("node", "body"), "body", "set", "array<long>", shingles_of).select("node", "set"), "shingles")

    def alike(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose shingles are similar enough."""
        pairs = saved(pairs, "candidates")
        sets = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
        both = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u")
        both = both.join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
        common = F.size(F.array_intersect("a", "b"))
        enough = common * SIMILARITY[1] >= (F.size("a") + F.size("b") - common) * SIMILARITY[0]
        return saved(both.filter(enough).select("u", "v"), "alike")

    def alike_in_cells(crowds: DataFrame) -> DataFrame:
        """Links of similar shingles that connect what the partners of crowded buckets connect."""
        crowds = saved(crowds, "crowds")
        rows = crowds.join(sets_of(crowds.select("node").distinct()), "node").select("cell", "node", "partners", "set")
        return saved(rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_verified, "u long, v long"), "linked")

    def links(classes: DataFrame) -> DataFrame:
        plan = word_plan(*bit_counts(classes, WORDS))
        counts = place_counts(classes, plan)
        found = alike(leader_pairs(classes, plan, counts))
        # Crowded buckets of ever more words: what is linked by the first ones does not meet in the others again.
        # All similar pairs of a wave's buckets are connected by its links, so the next one leaves out its parts.
        done = 0
        for words in (*CROWD_WAVES, WORDS):
            led, upto = components(found), sum(p[0] < words for p in plan)
            crowds = crowded_partners(classes, led, plan[done:upto], counts[done * KEYS : upto * KEYS])
            found, done = found.union(alike_in_cells(crowds)), upto
        return found.union(alike(few_pairs(classes, led, plan, counts)))

    groups = grouped(prints, "key", links).select("node", "root")
    order = F.struct(F.col("key").isNull().alias("none"), "key", "mark")
    best = prints.join(groups, "node").groupBy("root").agg(F.min(order).alias("best")).select("best.key", "best.mark")
    best = best.select(F.col("mark").alias(one)).distinct()
    kept = documents.withColumn(one, mark).join(best, one, "left_semi")
    # Equal rows: one of them stays; only rows whose mark occurs twice are compared.
    twice = prints.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("mark").alias(one))
    single = kept.join(twice, one, "left_anti")
    repeated = kept.join(twice, one, "left_semi").dropDuplicates([one])
    return single.unionByName(repeated).drop(one)
