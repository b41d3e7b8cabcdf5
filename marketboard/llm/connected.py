"""Connected components as alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketboard.llm.common import saved


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them."""
    least = _smallest(edges)
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter(F.col("u") > F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(hashed), F.sum(F.shiftright(hashed, 20))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root: every node of the links (columns u, v; numbers) with the smallest node that it reaches.

    Only minima and pairs of one node are formed, so a node with very many links costs no more than its links.
    Each round is written to the shared folder; a few rounds are enough, as distances about halve in each.
    """
    pairs = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = saved(pairs.filter("u > v").distinct(), "links")
    state = _state(edges)
    while state[0]:
        edges = saved(_small_star(_large_star(edges)), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
