"""Vector search, scores over candidates, and ranking metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOT_EPS = 1e-8
#: Nodes of a block and queries of a chunk: a cell of the two holds so many products at most.
BLOCK, CHUNK = 4096, 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(DOT_EPS))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def _cell(metric: str, k: int | None, digits: int):
    """All products of a chunk of queries with a block of nodes, or each query's ``k`` best and what ties with them."""

    def run(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        parts = [t.filter(pa.array(side == s)) for s in (0, 1)]
        if not parts[0].num_rows or not parts[1].num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "idx": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        (ids, x), (queries, q) = ((p.column("id").to_numpy(), _rows(p.column("x"))) for p in parts)
        squares = lambda m: (m * m).sum(1)
        value = q @ x.T
        if metric == "euclidean":
            value = np.sqrt(np.maximum(squares(q)[:, None] + squares(x)[None] - 2 * value, 0))
        else:
            value /= np.outer(*(np.maximum(np.sqrt(squares(m)), DOT_EPS) for m in (q, x)))
        keep = queries[:, None] != ids[None]
        if k is not None and k < len(ids):
            better = np.where(keep, value if metric == "euclidean" else -value, np.inf)
            keep &= better <= np.partition(better, k - 1, axis=1)[:, k - 1 : k] + 10.0**-digits
        i, j = np.nonzero(keep)
        return pa.table({"query": queries[i], "idx": ids[j], "score": value[i, j]})

    return run


def _blocked(queries: DataFrame, nodes: DataFrame, metric: str, k: int | None, digits: int) -> DataFrame:
    n, nq = nodes.count(), queries.count()
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-nq // CHUNK))
    number = lambda c, many: F.pmod(F.xxhash64(c), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    vector = lambda c: F.col(c).cast("array<double>").alias("x")
    left = nodes.select(number("idx", blocks).alias("b"), every(chunks).alias("c"), F.lit(0).alias("side"), F.col("idx").cast("long").alias("id"), vector("embedding"))
    right = queries.select(every(blocks).alias("b"), number("query", chunks).alias("c"), F.lit(1).alias("side"), F.col("query").cast("long").alias("id"), vector("q"))
    found = left.unionByName(right).groupBy("b", "c").applyInArrow(_cell(metric, k, digits), "query long, idx long, score double")
    return found.withColumn("score", F.round("score", digits))


def scores(queries: DataFrame, nodes: DataFrame, metric: str, digits: int = 6) -> DataFrame:
    """(query, idx, score) of every query against every other node; distances or cosines, rounded.

    ``queries`` is a stated query set (query, q) against all nodes (idx, embedding; vectors of one length, not null),
    in blocks: matrix products of bounded cells, dealt by keys of their own.
    """
    return _blocked(queries, nodes, metric, None, digits)


def near(queries: DataFrame, nodes: DataFrame, metric: str, k: int, digits: int = 6) -> DataFrame:
    """(query, idx, score, rank): each query's ``k`` nearest other nodes; only a cell's best leave it."""
    return top_k(_blocked(queries, nodes, metric, k, digits), k, metric == "euclidean")


def top_k(scored: DataFrame, k: int, ascending: bool, by: str = "query") -> DataFrame:
    """Ranked rows of each query; ties go to the smaller idx; Spark limits each group before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.asc("score") if ascending else F.desc("score"), "idx")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def log_softmax(scored: DataFrame, temperature: float = 0.01, by: str = "query") -> DataFrame:
    """Adds logp: log softmax of score / temperature within each query, with the maximum subtracted.

    Maximum and sum are aggregates with a map-side part, joined back, so that no query's rows meet in one task.
    """
    z = F.col("score") / temperature
    peak = scored.groupBy(by).agg(F.max("score").alias("_peak"))
    total = scored.join(peak, by).groupBy(by).agg(F.first("_peak").alias("_peak"), F.sum(F.exp(z - F.col("_peak") / temperature)).alias("_sum"))
    return scored.join(total, by).withColumn("logp", z - F.col("_peak") / temperature - F.log("_sum")).drop("_peak", "_sum")


def hits_at(scored: DataFrame, gold: DataFrame, ks: list[int], by: str = "query") -> DataFrame:
    """For each query whether its gold idx is among the k best, for every k; k beyond the candidates is clamped.

    The rank of gold is one more than the count of better candidates (higher score, then smaller idx).
    """
    with_gold = scored.join(gold, by)
    its = with_gold.where("idx = gold").groupBy(by).agg(F.max("score").alias("_gold"))
    better = (F.col("score") > F.col("_gold")) | (F.col("score") == F.col("_gold")) & (F.col("idx") < F.col("gold"))
    place = with_gold.join(its, by, "left").groupBy(by).agg(F.max("_gold").alias("_gold"), F.count_if(better).alias("_above"))
    return place.select(by, *[(F.col("_gold").isNotNull() & (F.col("_above") < k)).cast("int").alias(f"hit{k}") for k in ks])


def pad_by_cycling(ranked: DataFrame, n: int, by: str = "query") -> DataFrame:
    """The n best of each query; with m < n of them place i takes rank (i - 1) mod m + 1."""
    m = ranked.groupBy(by).agg(F.least(F.max("rank"), F.lit(n)).alias("m"))
    want = m.withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("rank", ((F.col("place") - 1) % F.col("m") + 1).cast("int"))
    return want.join(ranked, [by, "rank"]).select(by, "place", "idx")


def knn_lm(lm: DataFrame, neighbours: DataFrame, weight: float = 0.25, temperature: float = 1.0, by: str = "query") -> DataFrame:
    """(query, token, p) = weight * p_knn + (1 - weight) * p_lm.

    ``lm`` has (query, token, p).  ``neighbours`` has (query, token, dist): p_knn is the softmax of
    -dist / temperature over a query's neighbours, summed by token.  A query without neighbours keeps its p.
    """
    w = Window.partitionBy(by)
    z = -F.col("dist") / temperature
    e = neighbours.withColumn("e", F.exp(z - F.max(z).over(w)))
    per = e.withColumn("p_knn", F.col("e") / F.sum("e").over(w)).groupBy(by, "token").agg(F.sum("p_knn").alias("p_knn"))
    # tokens that only one side knows are there too
    both = lm.select(by, "token", F.col("p").alias("p_lm")).join(per, [by, "token"], "full").join(neighbours.select(by).distinct().withColumn("met", F.lit(True)), by, "left")
    p_lm, p_knn = F.coalesce("p_lm", F.lit(0.0)), F.coalesce("p_knn", F.lit(0.0))
    return both.select(by, "token", F.when(F.col("met"), weight * p_knn + (1 - weight) * p_lm).otherwise(p_lm).alias("p"))


def retriever_scores(ranked: DataFrame, ks: list[int], by: str = "query") -> DataFrame:
    """Each query's predicted order against its gold order, from rows (by, score, gold: rank from 0 by gold score).

    inversions; avg_k: share of the k best by score whose gold rank is below k; need_k: how many of the best by score
    it takes to have all gold ranks below k.
    """
    row = F.struct((-F.col("score")).alias("s"), F.col("gold"))
    x = F.transform(F.sort_array(F.collect_list(row)), lambda r: r["gold"])
    one = ranked.groupBy(by).agg(x.alias("x"))
    from ..functions.text import inversions

    below = lambda k: F.transform(F.col("x"), lambda v: v < k)
    share = [F.round(F.aggregate(F.slice(below(k), 1, k), F.lit(0.0), lambda a, v: a + v.cast("double")) / F.least(F.lit(k), F.size("x")), 6).alias(f"avg_{k}") for k in ks]
    need = [(F.size("x") - F.array_position(F.reverse(below(k)), True) + 1).cast("long").alias(f"need_{k}") for k in ks]
    return one.select(by, inversions(F.col("x")).cast("long").alias("inversions"), *share, *need)
