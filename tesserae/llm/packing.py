"""Conflict-constrained best-fit packing of token sequences into bins.

Documents are dealt by a hash into shards of bounded size; each shard packs its own pieces, longest first.  A
shard's bins stand in order of their residual capacity, and each carries a bitmap of the sources and one of the
duplicate clusters inside it.  For a piece the search starts at the smallest residual that holds it and goes on to
the successors until a bin has neither the piece's source nor its cluster: the tightest compatible bin, and the
first made among those of one residual.  The bins that a shard leaves more than ``SLACK`` empty are then opened, and
their pieces packed again together with those of other shards.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Tokens of a bin; documents of a shard; the share of a bin that may stay empty; pieces that meet in a second packing.
CAPACITY, SHARD_DOCS, SLACK, SECOND = 2048, 2048, 0.1, 8192
#: Bins of the second packing have this bit.
AGAIN = 1 << 62
WIDE = "doc_id long, piece int, token_start long, n_tokens int, bin_id long, bin_offset int, source string, cluster long, used int"
WIDE_NAMES = [c.split()[0] for c in WIDE.split(", ")]


def token_count(text):
    """Words [^\\x20\\x09-\\x0D]+ and one end token."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, in the given order; sizes are at most ``capacity``."""
    residuals: list[int] = []  # those that some bin has, ascending
    at: dict[int, list[int]] = {}  # bins by residual, ascending
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c, home = 1 << source, 1 << cluster, -1
        for i in range(bisect_left(residuals, size), len(residuals)):
            residual = residuals[i]
            home = next((b for b in at[residual] if not (source_bits[b] & s or cluster_bits[b] & c)), -1)
            if home >= 0:
                at[residual].remove(home)
                if not at[residual]:
                    del at[residual], residuals[i]
                break
        else:
            home, residual = len(source_bits), capacity
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[home] |= s
        cluster_bits[home] |= c
        out.append((home, capacity - residual))
        if size < residual:
            if residual - size not in at:
                insort(residuals, residual - size)
            insort(at.setdefault(residual - size, []), home)
    return out


def _placed(pieces: list[tuple], capacity: int, shard: int) -> pa.Table:
    """``pieces`` (tokens, doc_id, source, cluster, piece, start) packed, longest first, in bins numbered from ``shard``."""
    pieces.sort(key=lambda p: (-p[0], p[1] is None, p[1] or 0, p[2] is None, p[2] or "", p[3], p[4]))
    number = lambda xs: (lambda seen: [seen.setdefault(x, len(seen)) for x in xs])({})
    sizes, docs, sources, clusters, nth, starts = (list(x) for x in zip(*pieces, strict=True))
    placed = best_fit(sizes, number(sources), number(clusters), capacity)
    used: dict[int, int] = {}
    for (b, _), size in zip(placed, sizes, strict=True):
        used[b] = used.get(b, 0) + size
    longs = {"doc_id": docs, "token_start": starts, "bin_id": [shard + b for b, _ in placed], "cluster": clusters}
    ints = {"piece": nth, "n_tokens": sizes, "bin_offset": [o for _, o in placed], "used": [used[b] for b, _ in placed]}
    t = {c: pa.array(v, pa.int64()) for c, v in longs.items()} | {c: pa.array(v, pa.int32()) for c, v in ints.items()} | {"source": pa.array(sources, pa.string())}
    return pa.table({c: t[c] for c in WIDE_NAMES})


def _shard(capacity: int):
    """All of a shard's rows, cut into pieces."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        rows = zip(*(t.column(c).to_pylist() for c in ("doc_id", "source", "cluster", "tokens")), strict=True)
        pieces = [(min(capacity, tokens - a), doc, source, cluster, n, a) for doc, source, cluster, tokens in rows for n, a in enumerate(range(0, tokens, capacity))]
        return _placed(pieces, capacity, key[0].as_py() << 32)

    return run


def _second(capacity: int):
    """Pieces of opened bins of many shards."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        return _placed(list(zip(*(t.column(c).to_pylist() for c in ("n_tokens", "doc_id", "source", "cluster", "piece", "token_start")), strict=True)), capacity, AGAIN | key[0].as_py() << 32)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, cluster_col: str | None = None, slack: float = SLACK) -> DataFrame:
    """A row for each piece of each row of ``docs`` (doc_id, text, source), with its bin and place.

    Returns doc_id, piece, token_start, n_tokens, bin_id, bin_offset, source, cluster.  A document longer than a
    bin is cut into full bins and a remainder; no bin holds two pieces of one source or of one cluster.  The
    cluster is ``cluster_col`` (long), else a hash of the text, so that exact copies are one.  Cases: a null or
    empty text is one end token; texts of any length are cut whole; pieces of one size stand in the order of doc_id,
    source, cluster and piece (nulls last), and of bins with one residual the first made takes a piece; null sources
    are one source, null clusters one cluster; null doc_ids and repeated rows are packed like others, each on its
    own, and are dealt out over shards like others; other columns are ignored; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    cluster = F.xxhash64("text") if cluster_col is None else F.col(cluster_col).cast("long")
    rows = docs.select("doc_id", "source", F.coalesce(cluster, F.lit(0)).alias("cluster"), token_count(F.col("text")).alias("tokens"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.save(rows, "rows")  # row numbers are drawn once; they keep copies from one shard
    shards = max(1, -(-rows.count() // shard_docs))
    dealt = rows.select("*", F.pmod(F.xxhash64("doc_id", "cluster", "row"), F.lit(shards)).alias("shard"))
    first = scratch.save(dealt.groupBy("shard").applyInArrow(_shard(capacity), WIDE), "first")
    loose = first.where(F.col("used") < capacity * (1 - slack))
    if shards == 1 or loose.isEmpty():
        return first.drop("used")
    # whole bins are dealt, so that what was packed together meets again
    groups = max(1, -(-loose.count() // SECOND))
    again = loose.withColumn("shard", F.pmod(F.xxhash64("bin_id"), F.lit(groups))).groupBy("shard").applyInArrow(_second(capacity), WIDE)
    return first.where(F.col("used") >= capacity * (1 - slack)).unionByName(again).drop("used")
