"""Graph expansion: bounded breadth-first search, simple paths, typed patterns, hop labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialised

#: Allowed strings of edge types along a path, by type of the node it starts from.
PATTERNS = {
    0: ["0", "2", "3", "04", "23", "24", "34", "041", "241", "341"],
    1: ["0", "1", "2", "3", "4", "03", "11", "13", "14", "30", "33", "40", "41", "43", "44", "034", "133", "144", "304", "403", "4034"],
    2: ["0", "1", "3", "4", "03", "13", "14", "30", "41", "43", "44", "034", "411", "441", "034"],
}


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions, distinct."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct()


def hops(starts: DataFrame, steps: DataFrame, radius: int | None, key: str = "center") -> DataFrame:
    """(key, idx, hop): least number of steps (a, b) from each start, up to ``radius`` (None: all).

    ``starts`` has key and idx.  Each round joins the frontier with the steps and drops what was reached; it ends
    with an empty frontier, so unreachable nodes do not stop it.
    """
    reached = front = materialised(starts.select(key, "idx").distinct().withColumn("hop", F.lit(0)))
    depth = 0
    while radius is None or depth < radius:
        depth += 1
        ahead = front.join(steps, front.idx == steps.a).select(key, F.col("b").alias("idx")).distinct()
        front = materialised(ahead.join(reached.select(key, "idx"), [key, "idx"], "left_anti").withColumn("hop", F.lit(depth)))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def bfs(centers: DataFrame, edges: DataFrame, radius: int, max_size: int | None = None) -> DataFrame:
    """(center, idx, hop) within ``radius`` undirected steps; at most ``max_size`` a centre by (hop, idx)."""
    out = hops(centers.select(F.col("idx").alias("center"), "idx"), undirected(edges), radius)
    if max_size is not None:
        w = Window.partitionBy("center").orderBy("hop", "idx")
        out = out.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_size).drop("rn")
    return out


def simple_paths(centers: DataFrame, edges: DataFrame, max_edges: int) -> DataFrame:
    """(center, path, types): every simple undirected path of at most ``max_edges``; one row a typed step."""
    steps = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "etype").union(edges.select("dst", "src", "etype"))
    front = centers.select(F.col("idx").alias("center"), F.array("idx").alias("path"), F.lit("").alias("types"))
    out = front
    for _ in range(max_edges):
        last = F.element_at("path", -1)
        front = materialised(front.join(steps, last == F.col("a")).where(~F.array_contains("path", F.col("b"))).select("center", F.array_append("path", F.col("b")).alias("path"), F.concat("types", F.col("etype").cast("string")).alias("types")))
        out = out.unionByName(front)
    return out


def pattern_expand(centers: DataFrame, nodes: DataFrame, edges: DataFrame, max_edges: int, mode: str, patterns: dict[int, list[str]] | None = None) -> DataFrame:
    """(center, idx): nodes of the paths whose edge types are allowed for the type of the centre.

    ``mode`` "intended" compares the whole string of types, "last_edge" the last type alone.
    """
    rows = [(t, p) for t, ps in (patterns or PATTERNS).items() for p in sorted(set(ps))]
    allowed = nodes.sparkSession.createDataFrame(rows, "node_type int, pattern string")
    paths = simple_paths(centers, edges, max_edges).where("types <> ''").join(nodes.select(F.col("idx").alias("center"), "node_type"), "center")
    found = F.col("types") if mode == "intended" else F.substring("types", -1, 1)
    return paths.withColumn("pattern", found).join(F.broadcast(allowed), ["node_type", "pattern"], "left_semi").select("center", F.explode("path").alias("idx")).distinct()
