"""Approximate nearest neighbours by a permutation index.

``PIVOTS`` vectors of a bounded sample, far apart, are the pivots.  A vector is represented by its ``PREFIX`` nearest
pivots in order, and posted under each of them with its place there: a pivot's inverted file holds about one vector
in PIVOTS / PREFIX.  Vectors are dealt into blocks, each with its own inverted files, which are built once.  The
footrule distance of two prefixes is a constant minus twice the sum, over shared pivots, of PREFIX - max(place,
place), so that walking the files of a query's pivots ranks the vectors that share one.  The nearest ``SHARE`` of a
block and ``EACH`` more for each neighbour wanted, with all that stand at the same distance as the last of them, are
scored on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import in_cells, matrix, ranked, usable

#: Vectors of the sample; pivots, chosen from it far apart; pivots in a vector's prefix.
SAMPLE, PIVOTS, PREFIX = 4096, 2048, 64
#: What is reranked: a share of a block, and so many more for each neighbour wanted.
SHARE, EACH = 0.1, 5
#: Vectors of a block, queries of a chunk, vectors whose pivots are found together.
BLOCK, CHUNK, STRIP = 8192, 4096, 1024
INDEXED = "block long, ids binary, data binary, ends binary, posted binary, weight binary"


def lifted(m: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate gives every vector the length ``longest``: nearest then means largest inner product."""
    return np.hstack([m, np.sqrt(np.maximum(longest**2 - (m * m).sum(1), 0))[:, None]])


def spread(sample: np.ndarray, many: int = PIVOTS) -> np.ndarray:
    """Up to ``many`` different rows of ``sample``, each the farthest from those before it.

    Copies and near copies would be one pivot many times, and outweigh the others in every distance.
    """
    sample = np.unique(sample, axis=0)
    chosen = [0]
    near = sample @ sample[0]
    near[0] = np.inf
    while len(chosen) < min(many, len(sample)):
        at = int(near.argmin())
        chosen.append(at)
        np.maximum(near, sample @ sample[at], out=near)
        near[at] = np.inf
    return sample[chosen]


def prefixes(m: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each row's ``prefix`` nearest pivots, nearest first; ties go to the smaller number."""
    out = np.zeros((len(m), prefix), np.int32)
    for at in range(0, len(m), STRIP):
        far = -(m[at : at + STRIP] @ pivots.T)
        last = np.partition(far, prefix - 1, axis=1)[:, prefix - 1 : prefix]
        few = far <= last
        some = np.argsort(~few, axis=1, kind="stable")[:, : int(few.sum(1).max())]  # those at most as far, in order
        order = np.argsort(np.take_along_axis(np.where(few, far, np.inf), some, 1), axis=1, kind="stable")[:, :prefix]
        out[at : at + STRIP] = np.take_along_axis(some, order, 1)
    return out


def _indexing(sent, width: int, longest: float, prefix: int, query: bool):
    """A block's or chunk's packed row: vectors in the order of their ids, and their postings by pivot."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        pivots = sent.value
        ids, m = np.asarray(t.column("vec_id").combine_chunks()), matrix(t.column("v"), width)
        o = np.lexsort((*m.T[::-1], ids))  # a repeated id stands with the least of its vectors first
        o = o[np.concatenate([[True], ids[o][1:] != ids[o][:-1]])]
        ids, m = ids[o], m[o]
        near = prefixes(np.hstack([m, np.zeros((len(m), 1))]) if query else lifted(m, longest), pivots, prefix)
        if query:
            posted, weight, ends = near.astype(np.int16), np.zeros(0, np.uint8), np.zeros(0, np.int32)
        else:
            flat = near.ravel()
            by = np.argsort(flat, kind="stable")
            posted, weight = (by // prefix).astype(np.int32), (prefix - by % prefix).astype(np.uint8)
            ends = np.cumsum(np.bincount(flat, minlength=len(pivots))).astype(np.int32)
        return pa.table({"block": [key[0]], **{c: pa.array([x.tobytes()], pa.binary()) for c, x in (("ids", ids), ("data", np.ascontiguousarray(m)), ("ends", ends), ("posted", posted), ("weight", weight))}})

    return run


def _cell(width: int, k: int, share: float, each: int, prefix: int):
    def run(block: dict, chunk: dict) -> dict[str, np.ndarray]:
        x_ids, q_ids = (np.frombuffer(r["ids"], np.int64) for r in (block, chunk))
        x, q = (np.frombuffer(r["data"]).reshape(-1, width) for r in (block, chunk))
        ends = np.frombuffer(block["ends"], np.int32)
        begins = np.concatenate([[0], ends[:-1]])
        posted, weight = np.frombuffer(block["posted"], np.int32), np.frombuffer(block["weight"], np.uint8)
        walks = np.frombuffer(chunk["posted"], np.int16).reshape(-1, prefix)
        own = np.arange(prefix, 0, -1, dtype=np.uint8)
        take = min(len(x), int(np.ceil(share * len(x))) + each * k + 1)
        out = []
        for i in range(len(q)):
            files = [slice(a, b) for a, b in zip(begins[walks[i]], ends[walks[i]], strict=True)]
            met = np.concatenate([posted[s] for s in files])
            both = np.concatenate([np.minimum(weight[s], w) for s, w in zip(files, own, strict=True)])
            shared = np.bincount(met, both, len(x)).astype(np.int64)
            at_least = np.cumsum(np.bincount(shared)[::-1])[::-1]  # vectors that share so much or more
            near = np.flatnonzero(shared >= np.flatnonzero(at_least >= take)[-1])
            near = near[x_ids[near] != q_ids[i]]
            rows = x[near]
            rough = rows @ q[i]
            if len(near) > k:  # the product's last bits depend on the rows around it: what it ranks near the end stays
                good = np.flatnonzero(rough >= np.partition(rough, -k)[-k] - 1e-9 * max(1.0, np.abs(rough).max()))
                near, rows = near[good], rows[good]
            score = (rows * q[i]).sum(1)
            best = np.lexsort((x_ids[near], -score))[:k]
            out.append((np.full(len(best), q_ids[i]), x_ids[near[best]], score[best]))
        return dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True))

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float = SHARE, each: int = EACH, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` nearest found among the rows of ``vectors`` with another id, by largest inner product.

    ``queries`` has the same columns.  Returns query_id, rank (from 1), vec_id, score (the inner product of the
    original vectors, in double precision, summed in one order); ties go to the smaller vec_id.  The pivots are up
    to ``PIVOTS`` different vectors of a sample of ``SAMPLE``; every vector is indexed.  Cases: null ids and vectors
    that are null, zero, empty or hold a null or non-finite component take no part; vectors of unequal size are
    filled with zeros; a repeated id counts once, with the least of its vectors; other columns are ignored; fewer
    candidates give fewer rows; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    some = F.exists("v", lambda x: x != 0)
    x, q = (usable(df, id_col, vec_col).where(some) for df in (vectors, queries))
    square = F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)
    n, width, longest = x.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    nq, q_width = q.agg(F.count("*"), F.max(F.size("v"))).first()
    schema = "query_id long, vec_id long, score double"
    if not n or not nq:
        return ranked(spark.createDataFrame([], schema), k)
    width, longest = max(width, q_width), float(np.sqrt(longest))
    sample = x.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("v").toArrow()
    pivots = spread(lifted(matrix(sample.column("v"), width), longest))
    prefix = min(PREFIX, max(1, len(pivots) // 2))
    sent = spark.sparkContext.broadcast(pivots)

    def indexed(rows: DataFrame, many: int, query: bool) -> DataFrame:
        dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(many)).alias("block"), "vec_id", "v")
        return scratch.save(dealt.groupBy("block").applyInArrow(_indexing(sent, width, longest, prefix, query), INDEXED), f"index_{query}")

    n_chunks = -(-nq // CHUNK)
    blocks, chunks = indexed(x, -(-n // BLOCK), False), indexed(q, n_chunks, True)
    # every chunk meets every block's files
    cells = blocks.select(F.col("block").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_chunks - 1).cast("long"))).alias("c"))
    cells = scratch.save(cells, "cells")
    empty = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
    return ranked(scratch.save(in_cells(blocks, chunks, cells, _cell(width, k, share, each, prefix), schema, empty), "found"), k)
