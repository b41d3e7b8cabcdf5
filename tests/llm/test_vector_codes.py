"""Vector codes against a search of every entry for every part."""

import hashlib
import math

import numpy as np
import pytest

from marketboard.llm import vector_codes
from marketboard.llm.vector_codes import chosen_pivots, closest, pivot_distances

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, values int"


def brute(rows, parts, entries, rounds):
    """vec_id, code, error, label_error and digest of every row that takes part."""
    kept = [(i, v, g) for i, v, g in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    values = [[math.floor(256 * float(np.float32(x))) for x in v] for _, v, _ in kept]
    width = len(values[0]) // parts
    first = sorted((i, v) for (i, _, _), v in zip(kept, values, strict=True) if i is not None)[:entries]
    books = [[v[p * width : (p + 1) * width] for _, v in first] for p in range(parts)]

    def assign():
        out = []
        for v in values:
            row = []
            for p in range(parts):
                x = v[p * width : (p + 1) * width]
                row.append(min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[p])))
            out.append(row)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [v[p * width : (p + 1) * width] for v, row in zip(values, found, strict=True) if row[p][1] == j]
                if own:
                    books[p][j] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = assign()
    errors = [sum(d for d, _ in row) for row in found]
    labels = {}
    for (_, _, g), e in zip(kept, errors, strict=True):
        labels[g] = labels.get(g, 0) + e
    return sorted(
        [(i, "".join(f"{j:02x}" for _, j in row), e, labels[g], digest) for (i, _, g), row, e in zip(kept, found, errors, strict=True)], key=repr
    )


def vectors(n, width, seed, spread=1.0):
    random = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in random.normal(size=width) * spread], int(i) % 3) for i in random.permutation(n)]


@pytest.mark.parametrize("n,width,parts,entries", [(300, 8, 4, 16), (5, 4, 2, 16), (200, 16, 16, 8)])
def test_equals_brute_force(spark, n, width, parts, entries):
    rows = vectors(n, width, n)
    rows += [(None, rows[0][1], None), (n, None, 1), (n + 1, [], 1), (n + 2, [math.nan] * width, 1), (n + 3, [math.inf] * width, None)]
    rows += [(n + 4, [None] * width, 2), (0, rows[1][1], 7), (0, rows[1][1], 7), (n + 5, [0.0] * width, None)]
    frame = spark.createDataFrame([(i, v, g, "x", "y", 1) for i, v, g in rows], SCHEMA).repartition(3)
    out = vector_codes.compressed(frame, parts=parts, entries=entries)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows, parts, entries, 2)


def test_no_vectors(spark):
    frame = spark.createDataFrame([(1, None, 1, "x", "y", 1)], SCHEMA)
    assert vector_codes.compressed(frame).count() == 0
    assert vector_codes.compressed(frame.limit(0)).count() == 0


def test_lengths_that_do_not_fit(spark):
    frame = spark.createDataFrame([(1, [1.0] * 5, 1, "x", "y", 1)], SCHEMA)
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compressed(frame, parts=2)
    mixed = spark.createDataFrame([(1, [1.0] * 4, 1, "x", "y", 1), (2, [1.0] * 2, 1, "x", "y", 1)], SCHEMA)
    with pytest.raises(Exception, match="equal parts|dimensions"):
        vector_codes.compressed(mixed, parts=2).collect()


def test_pivots_prune_and_stay_exact():
    random = np.random.default_rng(3)
    entries = random.integers(-300, 300, (64, 4))
    rows = np.concatenate([random.integers(-300, 300, (3000, 4)), entries, (entries[:32] + entries[32:]) // 2])
    pivots = chosen_pivots(entries)
    which, best, computed = closest(rows, pivot_distances(rows, pivots), entries, pivot_distances(entries, pivots))
    every = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (which == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert computed < every.size / 4


def test_equal_entries_go_to_the_lower_index():
    entries = np.array([[5, 5], [1, 1], [1, 1], [5, 5]])
    rows = np.array([[1, 1], [5, 5], [3, 3]])
    pivots = chosen_pivots(entries)
    which, best, _ = closest(rows, pivot_distances(rows, pivots), entries, pivot_distances(entries, pivots))
    assert which.tolist() == [1, 0, 0] and best.tolist() == [0, 0, 8]


def test_codes_stand_for_near_vectors(spark):
    rows = vectors(400, 8, 1, 0.2)
    frame = spark.createDataFrame([(i, v, g, "x", "y", 1) for i, v, g in rows], SCHEMA)
    saved, books = vector_codes.fitted(frame, parts=4, entries=64)
    back = vector_codes.restored(vector_codes.coded(saved, books), books)
    given = {i: v for i, v, _ in rows}
    apart = [np.linalg.norm(np.array(r["vector"]) - given[r["id"]]) for r in back.collect()]
    assert np.mean(apart) < 0.6 * np.mean([np.linalg.norm(v) for v in given.values()])
    codes = spark.createDataFrame([(None, "kept")], "code string, vector string")
    assert vector_codes.restored(codes, books).collect()[0]["vector_"] is None
