"""Sharding by extendible hashing.

A row's path is 60 bits of a hash of its key and 60 bits of one of its text. The directory maps path prefixes to shards: only
a bucket over the byte limit splits on one more bit, so a shard is the shortest prefix of a path whose rows fit the limit.
Bits are tried a few at a time: sums of all prefixes of these bits come from one aggregate over their cells, and only rows
of cells that do not fit go on to the next bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketboard.llm.common import saved

SHARD_BYTES = 1 << 20
ROUND_BITS = 12
#: Bits of the key's hash and as many of the text's.
HASH_BITS = 60


def bits_of(value: Column) -> Column:
    digest = F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))
    return F.lpad(F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 2), HASH_BITS, "0")


def pathed(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    return documents.select(F.col(key).alias("key"), size.alias("size"), F.concat(bits_of(F.col(key)), bits_of(F.col(text))).alias("path"))


def directory_round(rows: DataFrame, begin: int, end: int, limit: int) -> DataFrame:
    """cell (path of `end` bits), shard: the shortest prefix of at least `begin` bits that fits, null if none does."""
    cells = rows.groupBy(F.substring("path", 1, end).alias("cell")).agg(F.sum("size").alias("size"))
    depth = F.explode(F.sequence(F.lit(begin), F.lit(end)))
    prefixes = saved(cells, "cells").withColumn("depth", depth).withColumn("prefix", F.expr("left(cell, depth)"))
    sums = prefixes.groupBy("depth", "prefix").agg(F.sum("size").alias("total")).filter(F.col("total") <= limit)
    fits = prefixes.join(sums, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return saved(cells_left(prefixes, begin).join(fits, "cell", "left").select("cell", F.expr("left(cell, depth)").alias("shard")), "directory")


def cells_left(prefixes: DataFrame, begin: int) -> DataFrame:
    return prefixes.filter(F.col("depth") == begin).select("cell")


def assignments(documents: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """key, size, shard (path prefix), depth (its bits), page, shard_bytes (of the page): one row for each row.

    Rows of one key with different texts part by the bits of the text. Rows alike in both share a whole path; if they exceed
    the limit, they go to numbered pages, each within the limit. A single text over the limit has a page for itself.
    Null and empty texts have size 0; a null key is hashed as empty. No documents: no rows. Other columns are not read.
    """
    rows = saved(pathed(documents, key, text), "paths")
    done, begin = [], 0
    while begin < 2 * HASH_BITS and not rows.isEmpty():
        end = min(begin + ROUND_BITS, 2 * HASH_BITS)
        found = directory_round(rows, begin, end, limit)
        joined = rows.withColumn("cell", F.substring("path", 1, end)).join(found, "cell")
        done.append(joined.filter("shard is not null").select("key", "size", "shard", F.lit(0).cast("long").alias("page")))
        rows = saved(joined.filter("shard is null").select("key", "size", "path"), "paths")
        begin = end
    # What is left cannot part: equal keys and texts. Such rows are counted and dealt out to pages by number.
    alike = rows.groupBy("path", "key", "size").agg(F.count("*").alias("n"))
    fit = F.greatest(F.floor(F.lit(limit) / F.greatest("size", F.lit(1))), F.lit(1))
    paged = alike.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    done.append(paged.select("key", "size", F.col("path").alias("shard"), F.floor(F.col("i") / fit).cast("long").alias("page")))
    out = saved(reduce(DataFrame.union, done), "shards")
    totals = out.groupBy("shard", "page").agg(F.sum("size").alias("shard_bytes"))
    out = out.join(totals, ["shard", "page"])
    return out.select(F.col("key").alias(key), "size", "shard", F.length("shard").alias("depth"), "page", "shard_bytes")


def shards(assigned: DataFrame) -> DataFrame:
    """shard, page, rows, bytes: the directory's buckets."""
    return assigned.groupBy("shard", "page").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def oracle(limit: int = SHARD_BYTES) -> str:
    """DuckDB SQL; for tables in which the first bits part everything."""
    return f"""
with d as (
  select doc_id, coalesce(strlen(text), 0)::bigint as size,
    right(repeat('0', {HASH_BITS}) || bin(('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, {HASH_BITS // 4}))::bigint), {HASH_BITS}) as path
  from documents
), sums as (
  select k, left(path, k) as shard, sum(size)::bigint as total from d, range(0, {HASH_BITS + 1}) t(k) group by 1, 2
), fit as (
  select d.doc_id, d.size, min(s.k) as depth from d, sums s
  where s.k <= {HASH_BITS} and s.shard = left(d.path, s.k) and s.total <= {limit} group by d.doc_id, d.size
)
select f.doc_id, f.size, left(d.path, f.depth) as shard, f.depth::int as depth, 0::bigint as page, s.total as shard_bytes
from fit f join d on f.doc_id = d.doc_id join sums s on s.k = f.depth and s.shard = left(d.path, f.depth)
"""
