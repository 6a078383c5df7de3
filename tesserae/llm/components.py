"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(scratch: Scratch, edges: DataFrame, large: bool, tag: str) -> DataFrame:
    """One star round over edges ``(u, v)`` with ``u > v``.

    Each node's neighbourhood is reduced to its smallest member by an aggregate with map-side combine.  That one row
    a node is written before it is joined back: read from a table of known size it is broadcast where it is small,
    and elsewhere both sides of the join have exchanges of their own, of which a hub's edges can be split.
    """
    if large:
        seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{tag}_low")
        out = seen.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = scratch.save(edges.groupBy("u").agg(F.min("v").alias("m")), f"{tag}_low")
        out = edges.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(scratch: Scratch, edges: DataFrame, tag: str) -> DataFrame:
    """``(node, component)`` for every node with an edge; component is its smallest reachable node.

    ``edges`` has long columns ``u`` and ``v``; loops, repeats and nulls are ignored.  Rounds run until the edges are
    stars: no node has two edges to a smaller one, and none has both a smaller and a larger neighbour.
    """
    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{tag}_0")
    k = 0
    while not _stars(now):
        k += 1
        half = scratch.save(_star(scratch, now, True, f"{tag}_{k}a"), f"{tag}_{k}a")
        nxt = scratch.save(_star(scratch, half, False, f"{tag}_{k}b"), f"{tag}_{k}")
        scratch.drop(f"{tag}_{k - 1}", f"{tag}_{k}a", f"{tag}_{k}a_low", f"{tag}_{k}b_low")
        now = nxt
    low = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(low.select("node", F.col("node").alias("component")))


def _stars(edges: DataFrame) -> bool:
    """Whether every node of edges ``u > v`` either has one edge to a smaller node or only edges to larger ones."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()
