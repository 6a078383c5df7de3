"""Message passing as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def features(nodes: DataFrame, dims: int) -> DataFrame:
    """(idx, pos, x): the first ``dims`` components of the embedding."""
    return nodes.select("idx", F.posexplode(F.slice(F.col("embedding").cast("array<double>"), 1, dims)).alias("pos", "x"))


def aggregate_neighbours(x: DataFrame, edges: DataFrame) -> DataFrame:
    """(idx, pos, mean, mn, mx, std, deg) over in-neighbours; std is sqrt(relu(E[x^2] - E[x]^2) + 1e-5)."""
    e = edges.select("src", "dst").distinct()
    sent = e.join(x.select(F.col("idx").alias("src"), "pos", "x"), "src")
    var = F.avg(F.col("x") * F.col("x")) - F.avg("x") * F.avg("x")
    return sent.groupBy(F.col("dst").alias("idx"), "pos").agg(F.round(F.avg("x"), 6).alias("mean"), F.min("x").alias("mn"), F.max("x").alias("mx"), F.round(F.sqrt(F.greatest(var, F.lit(0.0)) + 1e-5), 5).alias("std"), F.count("*").alias("deg"))


def sage_max(x: DataFrame, edges: DataFrame) -> DataFrame:
    """(idx, pos, h): relu(x + max over in-neighbours), 0 for none: identity weights."""
    top = aggregate_neighbours(x, edges).select("idx", "pos", "mx")
    return x.join(top, ["idx", "pos"], "left").select("idx", "pos", F.round(F.greatest(F.col("x") + F.coalesce("mx", F.lit(0.0)), F.lit(0.0)), 6).alias("h"))


def gcn(x: DataFrame, edges: DataFrame) -> DataFrame:
    """(idx, pos, h): sum of x / sqrt(deg deg) over in-neighbours and the node, degrees with self loops."""
    loops = x.select(F.col("idx").alias("src"), F.col("idx").alias("dst")).distinct()
    e = edges.select("src", "dst").union(loops).distinct()
    deg = e.groupBy(F.col("dst").alias("n")).agg(F.count("*").alias("d"))
    w = e.join(deg.select(F.col("n").alias("src"), F.col("d").alias("ds")), "src").join(deg.select(F.col("n").alias("dst"), F.col("d").alias("dd")), "dst")
    sent = w.join(x.select(F.col("idx").alias("src"), "pos", "x"), "src")
    return sent.groupBy(F.col("dst").alias("idx"), "pos").agg(F.round(F.sum(F.col("x") / F.sqrt(F.col("ds") * F.col("dd"))), 5).alias("h"))


def virtual_node(x: DataFrame, graph: DataFrame) -> DataFrame:
    """(idx, pos, h): each value plus the sum over its graph."""
    w = Window.partitionBy("graph", "pos")
    return x.join(graph, "idx").select("idx", "pos", F.round(F.col("x") + F.sum("x").over(w), 5).alias("h"))


def kernel_pool(x: DataFrame, members: DataFrame) -> DataFrame:
    """(idx, pos, centroid, subgraph, context): a node's own value as root, the mean over its subgraph, and the
    mean over the subgraphs that hold it of their roots' values."""
    inside = members.join(x, "idx")
    sub = inside.groupBy(F.col("sg").alias("idx"), "pos").agg(F.round(F.avg("x"), 5).alias("subgraph"))
    ctx = members.join(x.select(F.col("idx").alias("sg"), "pos", "x"), "sg").groupBy("idx", "pos").agg(F.round(F.avg("x"), 5).alias("context"))
    return x.withColumnRenamed("x", "centroid").join(sub, ["idx", "pos"]).join(ctx, ["idx", "pos"])


def link_scores(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, score): inner product of the L2-normalised embeddings."""
    from .search import cosine

    a, b = nodes.select(F.col("idx").alias("u"), F.col("embedding").alias("x")), nodes.select(F.col("idx").alias("v"), F.col("embedding").alias("y"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", F.round(cosine(F.col("x"), F.col("y")), 6).alias("score"))


def linear(x: DataFrame, weights: DataFrame) -> DataFrame:
    """(idx, pos, x): rows (idx, pos, x) through a matrix (pos, out, w)."""
    return x.join(F.broadcast(weights), "pos").groupBy("idx", F.col("out").alias("pos")).agg(F.sum(F.col("x") * F.col("w")).alias("x"))


def relu(x: DataFrame) -> DataFrame:
    return x.withColumn("x", F.greatest("x", F.lit(0.0)))


def neighbour_max(x: DataFrame, edges: DataFrame) -> DataFrame:
    """(idx, pos, x): the largest value among in-neighbours; nodes without any have no row."""
    e = edges.select("src", "dst").distinct()
    return e.join(x.select(F.col("idx").alias("src"), "pos", "x"), "src").groupBy(F.col("dst").alias("idx"), "pos").agg(F.max("x").alias("x"))


def sage(x: DataFrame, edges: DataFrame, own: DataFrame, theirs: DataFrame) -> DataFrame:
    """(idx, pos, x): W_own x + W_theirs max over in-neighbours, with given weights."""
    both = linear(x, own).unionByName(linear(neighbour_max(x, edges), theirs))
    return both.groupBy("idx", "pos").agg(F.sum("x").alias("x"))


def gin(x: DataFrame, edges: DataFrame, eps: float = 0.0) -> DataFrame:
    """(idx, pos, h): (1 + eps) x plus the sum over in-neighbours of relu of theirs, before the layer's network."""
    e = edges.select("src", "dst").distinct()
    sent = e.join(x.select(F.col("idx").alias("src"), "pos", "x"), "src").groupBy(F.col("dst").alias("idx"), "pos").agg(F.sum(F.greatest("x", F.lit(0.0))).alias("s"))
    return x.join(sent, ["idx", "pos"], "left").select("idx", "pos", F.round((1 + eps) * F.col("x") + F.coalesce("s", F.lit(0.0)), 5).alias("h"))


def gated(x: DataFrame, edges: DataFrame) -> DataFrame:
    """(idx, pos, h): x_i plus the sum over in-neighbours j of sigmoid(x_i + x_j) x_j: a residual gated layer with identity weights."""
    e = edges.select("src", "dst").distinct()
    both = e.join(x.select(F.col("idx").alias("src"), "pos", F.col("x").alias("y")), "src").join(x.select(F.col("idx").alias("dst"), "pos", "x"), ["dst", "pos"])
    sent = both.groupBy(F.col("dst").alias("idx"), "pos").agg(F.sum(F.col("y") / (1 + F.exp(-(F.col("x") + F.col("y"))))).alias("s"))
    return x.join(sent, ["idx", "pos"], "left").select("idx", "pos", F.round(F.col("x") + F.coalesce("s", F.lit(0.0)), 5).alias("h"))


def attended(x: DataFrame, edges: DataFrame, source: DataFrame, target: DataFrame, slope: float = 0.2) -> DataFrame:
    """(idx, pos, h): attention over in-neighbours and the node: softmax of leaky relu(a_source x_j + a_target x_i).

    ``source`` and ``target`` are weights (pos, w).  Maximum and sum are aggregates, joined back.
    """
    loops = x.select(F.col("idx").alias("src"), F.col("idx").alias("dst")).distinct()
    e = edges.select("src", "dst").union(loops).distinct()
    dot = lambda w, name: x.join(F.broadcast(w), "pos").groupBy(F.col("idx").alias(name)).agg(F.sum(F.col("x") * F.col("w")).alias(f"{name}_a"))
    a = F.col("src_a") + F.col("dst_a")
    e = e.join(dot(source, "src"), "src").join(dot(target, "dst"), "dst").select("src", "dst", F.when(a > 0, a).otherwise(slope * a).alias("a"))
    peak = e.groupBy("dst").agg(F.max("a").alias("peak"))
    e = e.join(peak, "dst").select("src", "dst", F.exp(F.col("a") - F.col("peak")).alias("e"))
    e = e.join(e.groupBy("dst").agg(F.sum("e").alias("total")), "dst")
    return e.join(x.select(F.col("idx").alias("src"), "pos", "x"), "src").groupBy(F.col("dst").alias("idx"), "pos").agg(F.round(F.sum(F.col("x") * F.col("e") / F.col("total")), 5).alias("h"))


def decoded(pairs: DataFrame, first: DataFrame, last: DataFrame) -> DataFrame:
    """(idx, score): a network of one hidden layer over pairs (idx, pos, x), the second vector's places after the first's.

    ``first`` is (pos, out, w), ``last`` (pos, w); relu between.
    """
    return relu(linear(pairs, first)).join(F.broadcast(last), "pos").groupBy("idx").agg(F.sum(F.col("x") * F.col("w")).alias("score"))


def masked_mean(tokens: DataFrame, by: str) -> DataFrame:
    """(by, pos, pooled): the mean over a group's tokens whose mask is set, of values (by, token, pos, x, mask)."""
    return tokens.groupBy(by, "pos").agg(F.round(F.sum(F.when(F.col("mask"), F.col("x"))) / F.count_if("mask"), 6).alias("pooled"))


def cross_attention(scores: DataFrame, layers: int, heads: int, by: str = "passage") -> DataFrame:
    """(by, score): attention on a passage's tokens (by, token, layer, head, score, mask), summed, over tokens, layers and heads."""
    tokens = F.count_distinct(F.when(F.col("mask"), F.col("token")))
    return scores.groupBy(by).agg(F.round(F.sum(F.when(F.col("mask"), F.col("score")).otherwise(0.0)) / (tokens * layers * heads), 6).alias("score"))
