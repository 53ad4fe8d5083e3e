"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import removed, stored


def _lowest(edges: DataFrame) -> DataFrame:
    """Each node ``u`` with the smallest of itself and its neighbours. Written out: a join with
    an aggregate can't be split where a node has very many edges, one with a table can."""
    return stored(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "lowest")


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Join each larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both)
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), low


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Join a node and its smaller neighbours to the smallest of them; v < u in ``edges``."""
    low = _lowest(edges)
    moved = edges.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).unionByName(moved).distinct(), low


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(u, v) % 1000003"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long); component is the smallest
    node reachable. Loops and repeated edges are harmless; an empty table gives an empty one.
    All work is partial aggregates and joins of written tables, so that a node with very many
    edges is split like any skewed key. Each step is written to the shared folder, and what
    no later step reads is deleted."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _digest(now)
    for _ in range(rounds):
        if not before[0]:
            break
        wide, low = _large_star(now)
        starred = stored(wide, "edges")
        narrow, low2 = _small_star(starred)
        after_ = stored(narrow, "edges")
        for old in (now, low, starred, low2):
            removed(old)
        now, after = after_, _digest(after_)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
