"""Vector code compression: a codebook for each part of a vector, fitted and searched with pivots.

Components become integers and vectors are cut into parts, so every distance is an exact integer. Some entries of the
first codebooks are the pivots: they never move, and the distances of every part to them are computed once and saved beside
it. In each round only the distances between pivots and entries are new. By the triangle inequality the difference of a
part's and an entry's distances to a pivot bounds their own distance from below; a part goes through the entries by ascending
bound, computes exact distances and ends when the next bound is beyond the best one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketboard.llm.common import fresh, saved

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
PIVOTS = 4
#: Parts whose bounds are held at once.
BLOCK = 4096
#: Integers beyond this make squared distances that may not fit 63 bits, whatever the number of components up to 2**20.
LARGEST = 1 << 20


def quantised(vectors: DataFrame, key: str, vector: str, label: str | None, scale: int) -> DataFrame:
    """id, label and values (array of long: floor of the scaled components) of the vectors that take part."""
    limit = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    usable = vectors.filter(F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0))
    values = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    group = F.col(label) if label else F.lit(None).cast("int")
    return usable.select(F.col(key).alias("id"), group.alias("label"), values.alias("values"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _squares(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all points."""
    return ((rows[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)


def chosen_pivots(entries: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Entries far from one another: the first, then each time the one farthest from those already taken."""
    taken = [0]
    apart = _squares(entries, entries[:1])[:, 0]
    while len(taken) < min(count, len(entries)):
        taken.append(int(apart.argmax()))
        apart = np.minimum(apart, _squares(entries, entries[taken[-1:]])[:, 0])
    return entries[taken]


def pivot_distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(_squares(rows, pivots).astype(np.float64))


def closest(rows: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row (ties: the lower index), its squared distance, and how many distances were computed.

    to_pivots: distances of rows and pivots; between: of entries and pivots. Bounds are floating point, so one counts as
    beyond the best distance only by more than its error.
    """
    bound = np.abs(to_pivots[:, None, 0] - between[None, :, 0])
    for p in range(1, between.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, None, p] - between[None, :, p]), out=bound)
    slack = 1e-9 * (1 + to_pivots.max(axis=1))
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1)
    best = np.full(len(rows), np.iinfo(np.int64).max)
    which = np.full(len(rows), len(entries))
    active, computed = np.arange(len(rows)), 0
    for place in range(len(entries)):
        if place:
            reach = np.sqrt(best[active].astype(np.float64))
            active = active[bound[active, place] <= reach + slack[active] + 1e-9 * reach]
        if not len(active):
            break
        entry = order[active, place]
        apart = ((rows[active] - entries[entry]) ** 2).sum(axis=1)
        computed += len(active)
        better = (apart < best[active]) | ((apart == best[active]) & (entry < which[active]))
        best[active[better]], which[active[better]] = apart[better], entry[better]
    return which, best, computed


@dataclass
class Codebooks:
    """entries: by part, entry and position in the part; pivots: by part and position, fixed through all rounds."""

    entries: np.ndarray
    pivots: list[np.ndarray]

    def cut(self, values: np.ndarray, part: int) -> np.ndarray:
        width = self.entries.shape[2]
        return values[:, part * width : (part + 1) * width]

    def assigned(self, values: np.ndarray, to_pivots: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each part: its number, the nearest entry and the squared distance of every row."""
        begin = 0
        for part, pivots in enumerate(self.pivots):
            end = begin + len(pivots)
            between = pivot_distances(self.entries[part], pivots)
            found = [
                closest(self.cut(values[at : at + BLOCK], part), to_pivots[at : at + BLOCK, begin:end], self.entries[part], between)[:2]
                for at in range(0, len(values), BLOCK)
            ]
            which, best = (np.concatenate(x) for x in zip(*found, strict=True))
            yield part, which, best
            begin = end

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """The parts of the rows with the smallest ids (equal ids: in the order of their values), at most `entries` rows."""
    some = rows.filter(F.col("id").isNotNull()).orderBy("id", "values").limit(entries).select("values").toArrow()
    if not len(some):
        return None
    widths = set(some.column(0).combine_chunks().value_lengths().to_pylist())
    if len(widths) > 1 or next(iter(widths)) % parts:
        raise ValueError(f"vectors cannot be cut into {parts} equal parts: {sorted(widths)} components")
    values = np.array(some.column(0).to_pylist(), np.int64)
    books = values.reshape(len(values), parts, -1).transpose(1, 0, 2).copy()
    return Codebooks(books, [chosen_pivots(book) for book in books])


def with_pivots(rows: DataFrame, books: Codebooks) -> DataFrame:
    """The rows with to_pivots, the distances of all their parts to the pivots: the only time that these are computed."""
    wide = books.entries.shape[0] * books.entries.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = set(batch.column("values").value_lengths().to_pylist()) - {wide}
            if lengths:
                raise ValueError(f"vectors have different dimensions: {sorted(lengths | {wide})}")
            values = _matrix(batch.column("values"))
            if len(values) and np.abs(values).max() > LARGEST:
                raise ValueError(f"scaled components beyond {LARGEST} are not supported")
            each = [pivot_distances(books.cut(values, part), pivots) for part, pivots in enumerate(books.pivots)]
            flat = np.concatenate(each, axis=1)
            ends = np.arange(len(values) + 1, dtype=np.int32) * flat.shape[1]
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "to_pivots"])

    kind = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind[0]}, label {kind[1]}, values array<long>, to_pivots array<double>")


def moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks whose entries are the floors of the means of their parts; entries without parts stay.

    A task sends one row of counts and sums for each entry, so what comes together does not depend on the rows.
    """
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            values = _matrix(batch.column("values"))
            for part, which, _ in books.assigned(values, _matrix(batch.column("to_pivots"))):
                counts[part] += np.bincount(which, minlength=entries)
                np.add.at(sums[part], which, books.cut(values, part))
        part, entry = np.nonzero(counts)
        columns = [part, entry, counts[part, entry], *sums[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "n", *[f"s{i}" for i in range(width)]])

    names = ["n", *[f"s{i}" for i in range(width)]]
    found = rows.select("values", "to_pivots").mapInArrow(run, "part long, entry long, " + ", ".join(f"{n} long" for n in names))
    totals = found.groupBy("part", "entry").agg(*[F.sum(n).alias(n) for n in names])
    after = books.entries.copy()
    # At most parts * entries rows.
    for part, entry, n, *total in zip(*[column.to_pylist() for column in totals.toArrow().columns], strict=True):
        after[part, entry] = [s // n for s in total]
    return Codebooks(after, books.pivots)


def coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """id, label, code (two hex digits for each part) and error of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.zeros((len(batch), len(books.pivots)), np.uint8)
            error = np.zeros(len(batch), np.int64)
            if len(batch):
                for part, which, best in books.assigned(_matrix(batch.column("values")), _matrix(batch.column("to_pivots"))):
                    codes[:, part] = which
                    error += best
            texts = [row.tobytes().hex() for row in codes]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(texts, pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    kind = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind[0]}, label {kind[1]}, code string, error long")


def fitted(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str | None = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebooks] | None:
    """The saved rows with their distances to the pivots, and the codebooks after all rounds; None without vectors.

    Rows with equal ids each count. A null id takes part but begins no codebook.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits for each part: at most 256 entries")
    rows = quantised(vectors, key, vector, label, scale)
    books = first_codebooks(rows, parts, entries)
    if books is None:
        return None
    rows = saved(with_pivots(rows, books), "parts")
    for _ in range(rounds):
        books = moved(rows, books)
    return rows, books


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **sizes) -> DataFrame:
    """key, code, error, label_error and codebooks_sha256 of every vector that takes part.

    Vectors that are null, empty or hold null or non-finite components take no part; a null label is one of its own.
    Repeated rows keep a row each. Fewer vectors than entries give smaller codebooks; no vector with an id, no rows. Vectors
    of different lengths, lengths that the parts do not divide and scaled components beyond 2**20 raise an error.
    """
    out = key, "code", "error", "label_error", "codebooks_sha256"
    found = fitted(vectors, key, vector, label, **sizes)
    if found is None:
        kind = vectors.schema[key].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    rows, books = found
    codes = saved(coded(rows, books), "codes")
    # One row for each label with a map-side half; how the two sides meet is left to Spark, which knows their sizes.
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    joined = codes.join(totals, codes["label"].eqNullSafe(F.col("_label")))
    return joined.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")).select(*out)


def restored(codes: DataFrame, books: Codebooks, code: str = "code", vector: str = "vector", scale: int = SCALE) -> DataFrame:
    """The rows with the vector that each code stands for (array of double, the middle of its cell); null codes: null."""
    width = books.entries.shape[2]
    table = F.lit(((books.entries.reshape(-1, width) + 0.5) / scale).tolist())
    entries = books.entries.shape[1]
    at = F.sequence(F.lit(0), F.lit(len(books.pivots) - 1))
    number = F.transform(at, lambda p: F.conv(F.substring(F.col(code), p * 2 + 1, F.lit(2)), 16, 10).cast("int") + p * entries)
    vectors = F.flatten(F.transform(number, lambda n: F.get(table, n)))
    return codes.withColumn(fresh(codes, vector), F.when(F.col(code).isNotNull(), vectors))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL for the rows of compressed: every part against every entry in each round."""
    text = f"""
with kept as materialized (
  select vec_id, label, [floor(x::double * {scale})::bigint for x in embedding] as v, row_number() over () as r
  from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), cut as materialized (
  select r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] as x from kept, range({parts}) t(p)
), e0 as materialized (
  select p, n - 1 as e, x from cut join (select r, row_number() over (order by vec_id, v) as n from kept where vec_id is not null) using (r) where n <= {entries}
)"""
    for i in range(rounds + 1):
        text += f""", a{i} as materialized (
  select r, p, min(struct_pack(d := d, e := e)) as m from (
    select c.r, c.p, e.e, list_sum([(a[1] - a[2]) * (a[1] - a[2]) for a in list_zip(c.x, e.x)])::bigint as d from cut c join e{i} e on c.p = e.p
  ) group by r, p
)"""
        if i < rounds:
            text += f""", m{i} as (
  select p, e, list(c order by j) as x from (
    select c.p, a.m.e as e, j, ((sum(c.x[j]) - (sum(c.x[j]) % count(*) + count(*)) % count(*)) // count(*))::bigint as c
    from cut c join a{i} a on a.r = c.r and a.p = c.p, unnest(range(1, len(c.x) + 1)) t(j) group by c.p, a.m.e, j
  ) group by p, e
), e{i + 1} as materialized (
  select e.p, e.e, coalesce(m.x, e.x) as x from e{i} e left join m{i} m on m.p = e.p and m.e = e.e
)"""
    return (
        text
        + f""", codes as (
  select r, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' order by p) as code, sum(m.d)::bigint as error from a{rounds} group by r
)
select k.vec_id, c.code, c.error, (sum(c.error) over (partition by k.label))::bigint as label_error,
  (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) from e{rounds}) as codebooks_sha256
from kept k join codes c using (r)
"""
    )
