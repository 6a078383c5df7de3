"""What both vector searches share: vectors packed into blocks, and cells of one candidate block and one query chunk.

Candidates and queries are packed into rows of bounded size.  A cell is one block against one chunk, so its
memory is bounded whatever the table holds, and cells are dealt out by a key of their own.  Queries are a stated
set against all rows, in blocks; which cells are worth making is decided from the marks of blocks and chunks alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ``mark`` is the first packed row's; ``extra`` has one double a vector.
PACKED = "block long, mark double, ids binary, extra binary, data binary"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, v)``: rows with an id and a vector without null or non-finite components, as doubles."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(fine)


def once(rows: DataFrame) -> DataFrame:
    """A repeated id counts once, with the least of its vectors."""
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """A list column as rows of ``width`` numbers, short vectors filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.asarray(column.offsets)
    flat, size = np.asarray(column.values)[at[0] : at[-1]], np.diff(at)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width).astype(kind, copy=False)
    out = np.zeros((len(size), width), kind)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(at[:-1] - at[0], size)] = flat
    return out


def in_partitions(rows: DataFrame, width: int, most: int, kind: type) -> DataFrame:
    """Each partition of ``rows`` (vec_id, v, mark, extra), in its order, as packed rows of at most ``most`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held, many = TaskContext.get().partitionId(), 0, [], 0

        def out(ts: list[pa.RecordBatch], n: int) -> pa.RecordBatch:
            ids, extra = (np.concatenate([np.asarray(t.column(c)) for t in ts]) for c in ("vec_id", "extra"))
            m = np.concatenate([matrix(t.column("v"), width, kind) for t in ts])
            return pa.RecordBatch.from_pydict({"block": pa.array([part << 32 | n]), "mark": pa.array([ts[0].column("mark")[0].as_py()], pa.float64()), "ids": pa.array([ids.tobytes()], pa.binary()), "extra": pa.array([extra.tobytes()], pa.binary()), "data": pa.array([m.tobytes()], pa.binary())})

        for b in batches:
            while b.num_rows:
                take = b.slice(0, most - many)
                held.append(take)
                many += take.num_rows
                b = b.slice(take.num_rows)
                if many == most:
                    yield out(held, n)
                    n, held, many = n + 1, [], 0
        if many:
            yield out(held, n)

    return rows.select("vec_id", "v", "mark", "extra").mapInArrow(run, PACKED)


def in_cells(blocks: DataFrame, chunks: DataFrame, cells: DataFrame, cell: Callable[[dict, dict], dict[str, np.ndarray]], schema: str, empty: dict[str, type]) -> DataFrame:
    """``cell(block row, chunk row)`` for each row of ``cells`` (b, c); only rows of live cells are copied."""
    fields = [f for f in blocks.columns if f != "block"]
    left = blocks.join(cells, blocks.block == cells.b).select("b", "c", F.lit(0).alias("side"), *fields)
    right = chunks.join(cells, chunks.block == cells.c).select("b", "c", F.lit(1).alias("side"), *fields)

    def run(t: pa.Table) -> pa.Table:
        rows = {r["side"]: r for r in t.to_pylist()}
        if len(rows) < 2:
            return pa.table({k: np.zeros(0, d) for k, d in empty.items()})
        return pa.table(cell(rows[0], rows[1]))

    return left.unionByName(right).groupBy("b", "c").applyInArrow(run, schema)


def best_of(row: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Indexes of each row's ``k`` best: higher scores first, then smaller ids; rows in order."""
    o = np.lexsort((ident, -score, row))
    r = row[o]
    first = np.searchsorted(r, r, "left")
    return o[np.arange(len(o)) - first < k]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query over all cells, with their ranks."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
