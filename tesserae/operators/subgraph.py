"""Subgraphs: induced, renumbered, combined; ancestors, walks, personalised PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialised
from .expand import hops
from .numbering import starts


def induced(members: DataFrame, edges: DataFrame, by: str = "sg") -> DataFrame:
    """(by, src, dst, etype): edges with both ends in one subgraph's members (by, idx)."""
    a, b = members.select(by, F.col("idx").alias("src")), members.select(by, F.col("idx").alias("dst"))
    return edges.join(a, "src").join(b, [by, "dst"]).select(by, "src", "dst", "etype")


def renumbered(members: DataFrame, by: str = "sg") -> DataFrame:
    """(by, idx, new): dense numbers from 0 in each subgraph, by old number."""
    return members.select(by, "idx").distinct().withColumn("new", F.row_number().over(Window.partitionBy(by).orderBy("idx")).cast("long") - 1)


def renumbered_edges(members: DataFrame, edges: DataFrame, by: str = "sg") -> DataFrame:
    n = renumbered(members, by)
    inside = induced(members, edges, by)
    s, d = n.select(by, F.col("idx").alias("src"), F.col("new").alias("new_src")), n.select(by, F.col("idx").alias("dst"), F.col("new").alias("new_dst"))
    return inside.join(s, [by, "src"]).join(d, [by, "dst"]).select(by, "new_src", "new_dst", "etype")


def ancestors(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(sg, idx, hop): nodes with a directed path of at most ``depth`` edges into the root, and the root."""
    into = edges.select(F.col("dst").alias("a"), F.col("src").alias("b")).distinct()
    return hops(roots.select(F.col("idx").alias("sg"), "idx"), into, depth, "sg")


def hop_labels(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """(idx, hop): directed steps from the nearest selected node; ends although nodes are unreachable."""
    one = hops(selected.select(F.lit(0).alias("all"), "idx"), edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), None, "all")
    return one.select("idx", "hop")


def walk_choice(seed: int, repeat: int, step: int):
    """A portable hash that picks the next neighbour from (root, node)."""
    return lambda root, node: (root * 7919 + node * 104729 + (seed + 31 * repeat + 7 * step)) % 1000003


def walks(roots: DataFrame, edges: DataFrame, length: int, repeats: int, seed: int = 1, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """(sg, idx): nodes on ``repeats`` walks of ``length`` steps along edges from each root, and the root.

    The next neighbour is picked by a hash of root, node and step; a node without one ends the walk.  With ``p`` or
    ``q`` other than 1 a step also depends on the node before: going back there weighs 1 / p, a neighbour of it 1,
    any other node 1 / q.
    """
    step = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    out = roots.select(F.col("idx").alias("sg"), "idx")
    if p != 1 or q != 1:
        step = materialised(step)
        for r in range(repeats):
            at = roots.select(F.col("idx").alias("sg"), "idx", F.lit(None).cast("long").alias("before"))
            for k in range(length):
                at = materialised(_biased_step(at, step, walk_choice(seed, r, k), p, q))
                out = out.union(at.select("sg", "idx"))
        return out.distinct()
    w = Window.partitionBy("a").orderBy("b")
    step = materialised(step.select("a", "b", (F.row_number().over(w) - 1).cast("long").alias("nth"), F.count("*").over(Window.partitionBy("a")).alias("many")))
    for r in range(repeats):
        at = roots.select(F.col("idx").alias("sg"), "idx")
        for k in range(length):
            pick = walk_choice(seed, r, k)(F.col("sg"), F.col("idx"))
            at = at.join(step, (F.col("idx") == F.col("a")) & (pick % F.col("many") == F.col("nth"))).select("sg", F.col("b").alias("idx"))
            out = out.union(at)
    return out.distinct()


def _biased_step(at: DataFrame, step: DataFrame, choice, p: float, q: float) -> DataFrame:
    """The walkers (sg, idx, before) one weighted step on: the first neighbour whose running weight passes the hash's share of all."""
    ahead = at.join(step, at.idx == step.a).select("sg", "idx", "before", "b")
    beside = step.select(F.col("a").alias("before"), "b", F.lit(True).alias("near"))
    weight = F.when(F.col("b") == F.col("before"), 1 / p).when(F.col("before").isNull() | F.col("near"), 1.0).otherwise(1 / q)
    one = Window.partitionBy("sg")
    rows = ahead.join(beside, ["before", "b"], "left").withColumn("w", weight).withColumns({"upto": F.sum("w").over(one.orderBy("b")), "all": F.sum("w").over(one)})
    share = choice(F.col("sg"), F.col("idx")) / F.lit(1000003.0)
    return rows.where(F.col("upto") > share * F.col("all")).groupBy("sg").agg(F.min("b").alias("to"), F.first("idx").alias("from")).select("sg", F.col("to").alias("idx"), F.col("from").alias("before"))


def ppr_topk(roots: DataFrame, edges: DataFrame, alpha: float = 0.1, rounds: int = 5, k: int = 10) -> DataFrame:
    """(root, idx, score, rank): k largest entries of each root's row after ``rounds`` of (1-a) A P + a I.

    A has distinct edges, divided by out-degree.  Mass moves from the root along edges, which gives the same
    rows: P_t = (1-a)^t A^t + a * sum_s (1-a)^s A^s.
    """
    e = edges.select("src", "dst").distinct()
    e = materialised(e.join(e.groupBy("src").agg(F.count("*").alias("deg")), "src"))
    walk = roots.select(F.col("idx").alias("root"), "idx", F.lit(1.0).alias("p"))
    out = walk.withColumn("p", F.col("p") * alpha)
    for t in range(1, rounds + 1):
        walk = materialised(walk.join(e, walk.idx == e.src).groupBy("root", F.col("dst").alias("i")).agg(F.sum(F.col("p") * (1 - alpha) / F.col("deg")).alias("p")).select("root", F.col("i").alias("idx"), "p"))
        out = out.union(walk.withColumn("p", F.col("p") * (alpha if t < rounds else 1.0)))
    total = out.groupBy("root", "idx").agg(F.round(F.sum("p"), 9).alias("score"))
    w = Window.partitionBy("root").orderBy(F.desc("score"), "idx")
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def combined(members: DataFrame) -> DataFrame:
    """(sg, idx, cid): one dense numbering of the disjoint union, in order of (sg, idx).

    Numbers within a subgraph are added to the running size of the subgraphs before it, summed range by range.
    """
    inner = members.withColumn("k", F.row_number().over(Window.partitionBy("sg").orderBy("idx")).cast("long") - 1)
    size = members.groupBy("sg").agg(F.count("*").alias("n"))
    start = starts(size, "sg", "n").select("sg", "start")
    return inner.join(start, "sg").select("sg", "idx", (F.col("start") + F.col("k")).alias("cid"))
