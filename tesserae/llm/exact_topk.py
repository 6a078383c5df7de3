"""Exact inner-product search over vectors in descending length, with rotated partial sums.

Vectors are ordered by length, longest first, and packed in that order.  An orthogonal rotation from the singular
vectors of the whole table puts most of every inner product into the first coordinates: the partial sum over
``HEAD`` of them plus the product of the residual lengths (Cauchy-Schwarz) bounds the whole from above.  The block
with the longest vectors meets all queries first, which gives each query a floor.  Queries are then packed in the
order of floor / length, and a block meets a chunk only if its longest vector can reach the least of these ratios,
which the marks of both tell before anything is copied.  Inside a cell a candidate is skipped where its bound stays
under the floor; what is left is computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import best_of, in_cells, in_partitions, matrix, once, ranked, usable

#: Vectors of a packed block; queries of a chunk; vectors bounded together; rotated coordinates summed first.
BLOCK, CHUNK, STRIP, HEAD = 16384, 4096, 1024, 24
#: Rows into which the executors add up the partitions' Gram matrices.
SUMS = 16
NO_FLOOR = -1e300


def _gram(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        g = np.zeros((width, width))
        for b in batches:
            m = matrix(b.column("v"), width)
            g += m.T @ m
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId() % SUMS]), "g": pa.array([g.tobytes()], pa.binary())})

    return run


def _added(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    return pa.table({"part": [key[0].as_py()], "g": pa.array([sum(np.frombuffer(x.as_buffer()) for x in t.column("g")).tobytes()], pa.binary())})


def _cell(rotation: np.ndarray, k: int, kind: type):
    width = len(rotation)
    head = min(HEAD, width)

    def run(block: dict, chunk: dict) -> dict[str, np.ndarray]:
        x_ids, q_ids = (np.frombuffer(r["ids"], np.int64) for r in (block, chunk))
        x, q = (np.frombuffer(r["data"], kind).reshape(-1, width).astype(np.float64) for r in (block, chunk))
        floor = np.frombuffer(chunk["extra"]).copy()
        qr = q @ rotation
        length = lambda m: np.sqrt((m * m).sum(1))
        q_len, q_rest = length(q), length(qr[:, head:])
        row, score, ident = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for at in range(0, len(x), STRIP):
            xs, xs_ids = x[at : at + STRIP], x_ids[at : at + STRIP]
            x_len = length(xs)
            live = np.flatnonzero(q_len * x_len.max() * (1 + 1e-9) + 1e-6 >= floor)
            if not len(live):
                continue
            xr = xs @ rotation
            bound = qr[live, :head] @ xr[:, :head].T + np.outer(q_rest[live], length(xr[:, head:]))
            bound += 1e-9 * np.outer(q_len[live], x_len) + 1e-6
            maybe = bound >= floor[live, None]
            maybe &= q_ids[live, None] != xs_ids[None]
            if maybe.mean() > 0.1:
                products = np.where(maybe, q[live] @ xs.T, -np.inf)
                kth = np.partition(products, -min(k, products.shape[1]), axis=1)[:, -min(k, products.shape[1])]
                i, j = np.nonzero(maybe & (products >= np.maximum(floor[live], kth)[:, None]))
                found = products[i, j]
            else:
                i, j = np.nonzero(maybe)
                found = np.einsum("ij,ij->i", q[live[i]], xs[j])
            row, score, ident = np.concatenate([row, live[i]]), np.concatenate([score, found]), np.concatenate([ident, xs_ids[j]])
            best = best_of(row, score, ident, k)
            row, score, ident = row[best], score[best], ident[best]
            count = np.bincount(row, minlength=len(q))
            last = np.cumsum(count) - 1
            full = count >= k
            floor[full] = np.maximum(floor[full], score[last[full]])
        return {"query_id": q_ids[row], "vec_id": ident, "score": score.astype(np.int64)}

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` largest integer inner products among the rows of ``vectors`` with another id.

    Components x become floor(scale * x) in double precision.  ``queries`` has the same columns.  Returns
    query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; fewer candidates give fewer rows.
    Cases: null ids, null vectors and vectors with a null or non-finite component take no part; vectors of
    unequal size are compared as if filled with zeros, so an empty vector scores 0; a repeated id counts once,
    with the least of its vectors; other columns are ignored; an empty table gives no rows.  Components so large
    that a product could reach 2**53, beyond which doubles are not exact, raise ValueError.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    whole = lambda df: once(usable(df, id_col, vec_col)).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))
    x, q = scratch.save(whole(vectors), "vectors"), scratch.save(whole(queries), "queries")
    largest = F.max(F.aggregate("v", F.lit(0.0), lambda a, b: F.greatest(a, F.abs(b))))
    n, width, top = x.agg(F.count("*"), F.max(F.size("v")), largest).first()
    nq, q_width, q_top = q.agg(F.count("*"), F.max(F.size("v")), largest).first()
    schema = "query_id long, vec_id long, score long"
    if not n or not nq:
        return ranked(spark.createDataFrame([], schema), k)
    width = max(width, q_width, 1)
    if top * q_top * width >= 2**53 or max(top, q_top) >= 2**31:
        raise ValueError("components are too large for exact inner products")
    kind = np.int16 if max(top, q_top) < 2**15 else np.int32
    sums = x.mapInArrow(_gram(width), "part long, g binary").groupBy("part").applyInArrow(_added, "part long, g binary").collect()
    rotation = np.linalg.eigh(sum(np.frombuffer(r.g) for r in sums).reshape(width, width))[1][:, ::-1].copy()
    sent = _cell(rotation, k, kind)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))
    by_length = x.withColumns({"mark": norm, "extra": F.lit(0.0)}).repartitionByRange(max(1, -(-n // BLOCK)), F.desc("mark"), "vec_id").sortWithinPartitions(F.desc("mark"), "vec_id")
    # a block's number is its partition's, shifted, plus its place there; the first one has the longest vectors
    blocks = scratch.save(in_partitions(by_length, width, BLOCK, kind), "blocks")
    lead = blocks.agg(F.min("block")).first()[0]
    empty = {"query_id": np.int64, "vec_id": np.int64, "score": np.int64}

    def pass_(floors: DataFrame | None) -> DataFrame:
        wide = q.withColumn("extra", F.lit(NO_FLOOR)) if floors is None else q.join(floors, q.vec_id == floors.query_id, "left").drop("query_id").withColumn("extra", F.coalesce("floor", F.lit(NO_FLOOR)))
        # what a vector's length must reach for the floor of this query
        wide = wide.withColumn("mark", F.when(norm > 0, F.col("extra") / norm).otherwise(F.lit(NO_FLOOR)))
        by_ratio = wide.repartitionByRange(max(1, -(-nq // CHUNK)), "mark", "vec_id").sortWithinPartitions("mark", "vec_id")
        chunks = scratch.save(in_partitions(by_ratio, width, CHUNK, kind), f"chunks_{floors is None}")
        some = blocks.where(F.col("block") == lead if floors is None else F.col("block") != lead)
        b, c = some.select(F.col("block").alias("b"), F.col("mark").alias("longest")), chunks.select(F.col("block").alias("c"), F.col("mark").alias("ratio"))
        # a row for each block and each chunk, without their vectors
        cells = scratch.save(b.join(c, F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("ratio")).select("b", "c"), f"cells_{floors is None}")
        return in_cells(some, chunks, cells, sent, schema, empty)

    first = scratch.save(pass_(None), "first")
    if blocks.where(F.col("block") != lead).isEmpty():
        return ranked(first, k)
    floors = first.groupBy("query_id").agg(F.min("score").cast("double").alias("floor"), F.count("*").alias("many")).where(F.col("many") >= k).drop("many")
    return ranked(first.unionByName(scratch.save(pass_(floors), "others")), k)
