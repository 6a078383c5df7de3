"""Sampling of subgraphs and rows; every choice is a portable hash."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered


def scramble(x: Column, seed: int) -> Column:
    return (x * 48271 + seed * 16807) % 2147483647


def random_roots(roots: DataFrame, rate: float, seed: int = 1) -> DataFrame:
    """floor(n * rate) roots without replacement: the first in an order by hash."""
    n = int(roots.count() * rate)
    return numbered(roots.withColumn("_h", scramble(F.col("idx"), seed)), "_h").where(F.col("nr") < n).drop("_h", "nr")


SAMPLED = "graph long, place int, sg long"


def _cover(redundancy: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        inside: dict[int, set[int]] = {}
        for sg, idx in zip(t.column("sg").to_pylist(), t.column("idx").to_pylist(), strict=True):
            inside.setdefault(sg, set()).add(idx)
        times = dict.fromkeys(set().union(*inside.values()), 0)
        chosen: list[int] = []
        while inside:
            low = min(times.values())
            if chosen and low >= redundancy:
                break
            best = min(inside, key=lambda sg: (-sum(times[x] == low for x in inside[sg]), sg))
            if not any(times[x] == low for x in inside[best]):
                break
            chosen.append(best)
            for x in inside.pop(best):
                times[x] += 1
        return _chosen(key, chosen)

    return run


def _chosen(key: tuple[pa.Scalar, ...], chosen: list[int]) -> pa.Table:
    return pa.table({"graph": pa.array([key[0].as_py()] * len(chosen), pa.int64()), "place": pa.array(range(len(chosen)), pa.int32()), "sg": pa.array(chosen, pa.int64())})


def set_cover(members: DataFrame, redundancy: int = 1) -> DataFrame:
    """(graph, place, sg): for each graph roots of its subgraphs (graph, sg, idx), in the order they are chosen.

    The largest subgraph comes first, then always the one with most of the least covered nodes (ties to the smaller
    root), until every node that some subgraph holds is covered ``redundancy`` times or all are chosen.  Choosing is
    sequential inside one graph, whose size the pipeline bounds, and graphs are chosen from side by side.
    """
    return members.select("graph", "sg", "idx").groupBy("graph").applyInArrow(_cover(redundancy), SAMPLED)


def _farthest(stride: int, redundancy: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        inside: dict[int, set[int]] = {}
        steps: dict[int, set[int]] = {}
        for a, b, sg in zip(*(t.column(c).to_pylist() for c in ("a", "b", "sg")), strict=True):
            if sg is not None:
                inside.setdefault(sg, set()).add(a)
            else:
                steps.setdefault(a, set()).add(b)
                steps.setdefault(b, set()).add(a)
        if not inside:
            return _chosen(key, [])
        nodes = sorted(set().union(*inside.values()))
        hop, times = dict.fromkeys(nodes, 1 << 30), dict.fromkeys(nodes, 0)
        far, chosen = min(inside, key=lambda sg: (-len(inside[sg]), sg)), []
        while len(chosen) < len(nodes):
            chosen.append(far)
            hop[far], front, depth = 0, [far], 0
            while front:  # only nodes that come nearer are walked on
                depth += 1
                ahead = {y for x in front for y in steps.get(x, ()) if hop.get(y, 1 << 30) > depth}
                hop |= dict.fromkeys(ahead, depth)
                front = list(ahead)
            for x in inside.get(far, ()):
                times[x] += 1
            top = min(nodes, key=lambda x: (-hop[x], x))
            if hop[top] < stride and min(times.values()) >= redundancy or top in chosen:
                break
            far = top
        return _chosen(key, chosen)

    return run


def farthest_roots(members: DataFrame, edges: DataFrame, stride: int, redundancy: int = 1) -> DataFrame:
    """(graph, place, sg): for each graph roots by farthest-point sampling over its edges (graph, src, dst).

    From the largest subgraph of ``members`` (graph, sg, idx) on, always the node farthest from those chosen
    (unreachable is farthest, ties to the smaller), until all are nearer than ``stride`` and covered.
    """
    rows = members.select("graph", F.col("idx").alias("a"), F.lit(None).cast("long").alias("b"), "sg").unionByName(edges.select("graph", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(None).cast("long").alias("sg")))
    return rows.groupBy("graph").applyInArrow(_farthest(stride, redundancy), SAMPLED)


def sampled(mode: str, members: DataFrame, edges: DataFrame, rate: float = 0.5, stride: int = 3, redundancy: int = 1, seed: int = 1) -> DataFrame:
    """(graph, sg): roots chosen by ``mode``: shortest_path, random or min_set_cover."""
    if mode == "shortest_path":
        return farthest_roots(members, edges, stride, redundancy).select("graph", "sg")
    if mode == "min_set_cover":
        return set_cover(members, redundancy).select("graph", "sg")
    if mode != "random":
        raise ValueError(f"unknown mode: {mode}")
    w = Window.partitionBy("graph")
    roots = members.select("graph", "sg").distinct().withColumn("r", F.row_number().over(w.orderBy(scramble(F.col("sg"), seed), "sg"))).withColumn("n", F.count("*").over(w))
    return roots.where(F.col("r") <= F.floor(F.col("n") * rate)).select("graph", "sg")


def transformed(members: DataFrame, edges: DataFrame, mode: str | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """Extracted subgraphs, sampled and put together: (members with cid, scale by graph).

    ``scale`` is how often the chosen subgraphs cover a node, over how many are chosen.
    """
    from .subgraph import combined

    kept = members if mode is None else members.join(sampled(mode, members, edges, **how), ["graph", "sg"], "left_semi")
    scale = kept.groupBy("graph").agg((F.count("*") / F.count_distinct("sg")).alias("scale"))
    return combined(kept.select("sg", "idx")), scale


def answer_choice(rows: DataFrame, key: str, answers: str, seed: int = 1) -> DataFrame:
    """Adds answer: one of the row's answers, picked by a hash of ``key``; null without any."""
    pick = F.pmod(scramble(F.col(key), seed), F.size(answers)) + 1
    return rows.withColumn("answer", F.when(F.size(answers) > 0, F.element_at(answers, pick.cast("int"))))


def mini_batches(rows: DataFrame, key: str, size: int, seed: int = 1) -> DataFrame:
    """Adds batch: rows shuffled by a hash of ``key`` and cut into batches of ``size``."""
    return numbered(rows.withColumn("_h", scramble(F.col(key), seed)), "_h", key).withColumn("batch", F.floor(F.col("nr") / size)).drop("_h", "nr")


def easy_negatives(queries: DataFrame, nodes: DataFrame, gold: DataFrame, many: int = 5, seed: int = 1) -> DataFrame:
    """(query, idx): ``many`` nodes of the query's file group that are not gold, by hash."""
    pool = nodes.join(queries, "file_id").join(gold, "query", "left").where("gold is null or idx <> gold")
    w = Window.partitionBy("query").orderBy(scramble(F.col("idx") + F.col("query"), seed), "idx")
    return pool.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= many).select("query", "idx")


def ordered_split(rows: DataFrame, key: str, ratio: float) -> DataFrame:
    """Adds is_train: the first floor(n * ratio) rows by ``key``; rows with one key stand in the order of their other columns."""
    n = int(rows.count() * ratio)
    return numbered(rows, key).withColumn("is_train", F.col("nr") < n).drop("nr")


def modulo_shard(rows: DataFrame, key: str, rank: int, world: int) -> DataFrame:
    return rows if rank < 0 else rows.where(F.pmod(F.col(key), F.lit(world)) == rank)


def carved(rows: DataFrame, key: str, has_validation: bool, part: int = 500, share: float = 0.1) -> DataFrame:
    """Adds split to the train rows of a data set, by the order of ``key``.

    Where the set has its own validation rows, the first 1/part of the rows is train and the rest null; else the
    first ``share`` is validation and the rest train.
    """
    if has_validation:
        return _first(rows, key, (1 + 1e-12) / part, "train", None)
    return _first(rows, key, share, "validation", "train")


def _first(rows: DataFrame, key: str, ratio: float, name: str, other: str | None) -> DataFrame:
    return ordered_split(rows, key, ratio).withColumn("split", F.when(F.col("is_train"), F.lit(name)).otherwise(F.lit(other))).drop("is_train")


def repo_split(texts: DataFrame, key: str, text: str = "text", least_chars: int = 25000, train: float = 0.8, seed: int = 1) -> DataFrame:
    """Adds is_train to ``texts`` by a hash of ``key``; a corpus with fewer characters is refused."""
    chars = texts.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    if chars < least_chars:
        raise ValueError(f"{chars} characters; at least {least_chars} are needed")
    return texts.withColumn("is_train", scramble(F.col(key) + 1, seed) % 1000 < int(round(train * 1000)))
