"""Near-duplicate documents: fast similarity sketching, banding, exact verification, connected components.

A document's set holds the 64-bit hashes of its distinct word shingles.  The sketch has ``SLOTS`` coordinates.
In round i every element of the set is thrown into one coordinate with a value that starts with i; a coordinate
keeps the least.  Rounds end once every coordinate holds something, and from round ``SLOTS`` on round i throws
the whole set into coordinate i - SLOTS, so that they do end.  Bands of ``ROWS`` coordinates are bucket keys.

Equal sets collapse before banding.  In each bucket all members meet the bucket's smallest member first, so that
a bucket makes as many pairs as it has members.  What that leaves open (members of one bucket in several components,
unless the triangle inequality of the Jaccard distance rules a link out) is settled exactly, family by family: all
that meet one leader.  Copies that were edited apart have their rarest shingles in common with most of their family,
so a prefix filter over the sets would pair a stray one with all of it.  Each set is therefore written as its
difference from the family's core (the shingles of more than half of it).  |x ^ y| = |X| + |Y| - 2 |X & Y| for the
differences X and Y, so whether sets link is a bound on what their differences share: where it is nothing, the one
nearest the core is linked with both; else they share one of the rarest elements of their differences, the edits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import GOLDEN, MIX_A, U64, Scratch, WordHashes, binary_rows, lists, mixed, slices, text_bytes, words
from .components import components

#: Coordinates of a sketch; coordinates of a band.  A pair at similarity 0.8 shares no band once in 300,000 times.
SLOTS, ROWS = 160, 5
#: Sketch agreement below DROP never reaches 0.8 (nine standard deviations); NEAR and FAR bound what may skip a
#: test by the triangle inequality, five standard deviations inside.
DROP, NEAR, FAR = 0.5, 0.8, 0.22
#: Sets and shingles, about, from which a family's core and frequencies are taken.  Results do not depend on them: any
#: core and any order of elements that a family shares are exact.
DRAWN, DRAWN_ITEMS = 512, 1 << 21
#: log2 of the most bits in the broadcast filter of wanted ids (16 MB); a fuller filter only lets more texts by.
MOST_BITS = 27
#: 64-bit words of the pieces in which that filter is put together.
PIECE = 1 << 13
#: Words of a batch that are hashed together.
BATCH_WORDS = 400_000


def shingle_set(text: bytes | None, hashes: WordHashes, k: int = 2) -> np.ndarray:
    """The sorted hashes of the distinct k-word shingles; with fewer words, of the whole sequence; else none."""
    w = words(text) if text else []
    if not w:
        return np.zeros(0, U64)
    h = np.fromiter(map(hashes.__getitem__, w), U64, len(w))
    k = min(k, len(w))
    out = h[: len(w) - k + 1]
    for i in range(1, k):
        out = mixed(out * MIX_A + U64(i)) + h[i : len(w) - k + 1 + i]
    return np.unique(mixed(out + U64(k)))


def sketches(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """The sketch of each non-empty set, one row each."""
    n = len(sets)
    out = np.full(n * slots, ~U64(0), U64)
    items, of = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    low = U64(0xFFFFFFFF)
    for i in range(2 * slots):
        h = mixed(items + U64((i + 1) * GOLDEN & (2**64 - 1)))
        bin_ = ((h >> U64(32)) * U64(slots) >> U64(32)).astype(np.int64) if i < slots else i - slots
        np.minimum.at(out, of * slots + bin_, U64(i << 32) | (h & low))
        open_ = (out.reshape(n, slots) == ~U64(0)).any(1)
        if not open_.any():
            break
        stay = open_[of]
        items, of = items[stay], of[stay]
    return out.reshape(n, slots)


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, slots = sketch.shape
    parts = sketch.reshape(n, slots // rows, rows)
    key = np.broadcast_to(np.arange(1, slots // rows + 1, dtype=U64) * U64(GOLDEN), parts.shape[:2]).copy()
    for j in range(rows):
        key = mixed(key ^ parts[:, :, j]) * MIX_A + U64(j)
    return key.view(np.int64)


def _sketched(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches, "text", BATCH_WORDS * 6):
            sets = [shingle_set(t, hashes, k) for t in text_bytes(b.column("text"))]
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            f = np.zeros((len(sets), 2), np.int64)
            bands, sig = np.zeros((len(sets), SLOTS // ROWS), np.int64), np.zeros((len(sets), SLOTS), np.uint8)
            if len(full):
                some = [sets[i] for i in full]
                f[full] = _prints(np.concatenate(some), np.concatenate([[0], np.cumsum(n[full])[:-1]]))
                s = sketches(some)
                bands[full], sig[full] = band_keys(s), (mixed(s) & U64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(f[:, 0]), pa.array(f[:, 1]), lists(bands.ravel(), SLOTS // ROWS), binary_rows(sig)], schema=schema)

    return run


def _prints(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two 64-bit sums for each of the sets that begin ``at`` these places of ``flat``: equal for equal sets."""
    return np.stack([np.add.reduceat(mixed(flat), at), np.add.reduceat(mixed(flat ^ U64(GOLDEN)), at)], 1).view(np.int64)


def _sets(k: int, wanted):
    schema = pa.schema([("doc_id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hashes = wanted.value, WordHashes()
        for b in slices(batches, "text"):
            b = b.filter(pa.array(_in_bitmap(bitmap, np.asarray(b.column("place")))))
            sets = [shingle_set(t, hashes, k) for t in text_bytes(b.column("text"))]
            full = np.array([len(s) > 0 for s in sets], bool)
            some = [s for s in sets if len(s)]
            f = _prints(np.concatenate(some), np.cumsum([0, *map(len, some[:-1])])) if some else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").filter(pa.array(full)), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array([s.tobytes() for s in some], pa.binary())], schema=schema)

    return run


def _piece(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    words_ = np.zeros(PIECE, np.int64)
    words_[np.asarray(t.column("w")) % PIECE] = np.asarray(t.column("b"))
    return pa.table({"p": [key[0].as_py()], "bits": pa.array([words_.tobytes()], pa.binary())})


def _bitmap(ids: DataFrame, many: int):
    """(bits, broadcast bitmap) of the hashes of column id; it has at most 2**MOST_BITS bits, put together in pieces by the executors."""
    bits = 1 << min(MOST_BITS, max(12, (16 * many).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    rows = ids.groupBy(F.floor(place / 64).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {bits}) % 64 as int))")).alias("b"))
    bitmap = np.zeros(-(-bits // 64 // PIECE) * PIECE, np.int64)
    for r in rows.withColumn("p", F.floor(F.col("w") / PIECE)).groupBy("p").applyInArrow(_piece, "p long, bits binary").collect():
        bitmap[r.p * PIECE : (r.p + 1) * PIECE] = np.frombuffer(r.bits, np.int64)
    return bits, ids.sparkSession.sparkContext.broadcast(bitmap.view(U64))


def _in_bitmap(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    place = place.astype(U64)
    return (bitmap[(place >> U64(6)).astype(np.int64)] >> (place & U64(63)) & U64(1)).astype(bool)


def _split(sent, inside: bool):
    """The rows whose ``_tesserae_place`` is in the bitmap, or the others; without that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_in_bitmap(sent.value, np.asarray(b.column("_tesserae_place"))) == inside)).drop_columns(["_tesserae_place"])

    return run


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, agreement of the sketches, less what chance gives a byte)."""
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, SLOTS) for c in ("sig_a", "sig_b"))
            e = ((x == y).mean(1) - 1 / 256) / (1 - 1 / 256)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(e)], names=["a", "b", "est"])


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("items_a"), b.column("items_b"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                at = np.searchsorted(large, small)
                same = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * same >= percent * (len(p) + len(q) - same))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _core(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """The shingles of more than half of a family's drawn sets, and how many differences hold each that was seen twice."""
    g, n = np.unique(np.frombuffer(b"".join(t.column("items").to_pylist()), U64), return_counts=True)
    inside = 2 * n > t.num_rows
    seen = inside | (n > 1)
    times = np.where(inside, t.num_rows - n, n)[seen].astype(np.int64)
    return pa.table({"lead": [key[0].as_py()], **{name: pa.array([x.tobytes()], pa.binary()) for name, x in (("core", g[inside]), ("seen", g[seen]), ("times", times))}})


def _differences(percent: int):
    """Each set as its difference from its family's core, rarest elements first, with its weight.

    Two sets are linked if their differences share ``(w + w') / (2 * (100 + percent))`` elements or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, w, out = [], [], []
            for x in zip(*(b.column(c) for c in ("items", "core", "seen", "times")), strict=True):
                # a family of which nothing was drawn has no core
                items, core, seen, times = (np.frombuffer(v.as_buffer() if v.is_valid else b"", kind) for v, kind in zip(x, (U64, U64, U64, np.int64), strict=True))
                d = np.setxor1d(items, core, assume_unique=True)
                at = np.minimum(np.searchsorted(seen, d), max(0, len(seen) - 1))
                often = np.where(seen[at] == d, times[at], 0) if len(seen) else np.zeros(len(d), np.int64)
                n.append(len(items))
                w.append((100 + percent) * len(d) - (100 - percent) * len(items))
                out.append(d[np.lexsort((d, often))].tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("lead", "id", "c", "away")), pa.array(n, pa.int64()), pa.array(w, pa.int64()), pa.array(out, pa.binary())], names=["lead", "id", "c", "away", "n", "w", "items"])

    return run


def _postings(percent: int):
    """Rows (lead, g, id, c, away, n, w, d, at): the first elements of a difference of d, one of which a link must share.

    ``low`` is the least weight of those that a set may be linked with, from which follows how much it shares at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, low = (np.asarray(b.column(c)) for c in ("w", "low"))
            d = np.asarray(pc.binary_length(b.column("items"))).astype(np.int64) // 8
            least = np.maximum(1, -(-(w + low) // (2 * (100 + percent))))
            many = np.maximum(0, d - least + 1)
            row = np.repeat(np.arange(b.num_rows), many)
            at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            parts = [np.frombuffer(x.as_buffer(), np.int64, k) for x, k in zip(b.column("items"), many.tolist(), strict=True) if k]
            out = b.select(["lead", "id", "c", "away", "n", "w"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(parts) if parts else at), pa.array(d[row]), pa.array(at)], names=[*out.schema.names, "g", "d", "at"])

    return run


class _Links:
    """Tests pairs of classes, by their numbers, and holds the links and components found so far."""

    def __init__(self, scratch: Scratch, docs: DataFrame, classes: DataFrame, k: int, percent: int):
        self.scratch, self.docs, self.classes, self.k, self.percent = scratch, docs, classes, k, percent
        self.links: list[DataFrame] = []
        self.found: DataFrame | None = None
        self.sets: DataFrame | None = None

    def estimate(self, pairs: DataFrame, tag: str) -> DataFrame:
        """``pairs`` (a > b, distinct) with the sketch estimate; saved."""
        left = self.classes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
        right = self.classes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
        both = pairs.select("a", "b").join(left, "a").join(right, "b")
        est = both.select("a", "b", "sig_a", "sig_b").mapInArrow(_estimated, "a long, b long, est double")
        return self.scratch.save(est, tag)

    def fetch(self, pairs: DataFrame, tag: str) -> None:
        """Compute the full sets that ``pairs`` need and that no earlier call has; texts are read once for all.

        A class's text is found by its smallest doc_id, and told from other texts of that id by its prints.
        """
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if self.sets is not None:
            nodes = nodes.join(self.sets.select(F.col("id").alias("node")), "node", "left_anti")
        ids = self.scratch.save(nodes.join(self.classes.select("node", F.col("rep").alias("id"), "f1", "f2"), "node"), f"{tag}_ids")
        many = ids.count()
        if not many:
            return
        # texts that cannot be wanted are left out before anything is shuffled
        bits, sent = _bitmap(ids, many)
        texts = self.docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("place")).where("doc_id is not null")
        sets = texts.mapInArrow(_sets(self.k, sent), "doc_id long, f1 long, f2 long, items binary").withColumnRenamed("doc_id", "id")
        new = self.scratch.save(sets.join(ids, ["id", "f1", "f2"]).groupBy(F.col("node").alias("id")).agg(F.first("items").alias("items")), f"{tag}_sets")
        self.sets = new if self.sets is None else self.sets.unionByName(new)

    def verify(self, pairs: DataFrame, tag: str) -> DataFrame:
        """Those of ``pairs`` (a, b) whose full sets reach the limit; saved."""
        a, b = self.sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")), self.sets.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
        return self.scratch.save(pairs.select("a", "b").join(a, "a").join(b, "b").mapInArrow(_linked(self.percent), "a long, b long"), tag)

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose ends are not in one component yet."""
        if self.found is None:
            return pairs
        f = self.found
        c = pairs.join(f.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(f.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        return c.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")

    def component_of(self, rows: DataFrame, node: str, name: str) -> DataFrame:
        """``rows`` with column ``name``: the component of ``node`` so far."""
        if self.found is None:
            return rows.withColumn(name, F.col(node))
        f = self.found.select(F.col("node").alias(node), F.col("component").alias(name))
        return rows.join(f, node, "left").withColumn(name, F.coalesce(name, node))

    def test(self, est: DataFrame, tag: str) -> None:
        """Links among estimated pairs: each document's likeliest pair first, then those still apart."""
        likely = est.where(F.col("est") >= DROP)
        self.fetch(likely, tag)
        if self.sets is None:  # no pair at all so far
            return
        best = likely.groupBy("a").agg(F.max_by("b", F.struct("est", -F.col("b"))).alias("b"))
        self._take(self.verify(best, f"{tag}_best"), f"{tag}_c1")
        rest = self.scratch.save(self.apart(likely.join(best, ["a", "b"], "left_anti")).select("a", "b"), f"{tag}_rest")
        if not rest.isEmpty():
            self._take(self.verify(rest, f"{tag}_more"), f"{tag}_c2")

    def settle(self, family: DataFrame, tag: str) -> None:
        """All links between different components inside the families ``family`` (lead, node, c)."""
        save, twice = self.scratch.save, 2 * (100 + self.percent)
        parts = family.join(self.classes.select("node", "n"), "node").groupBy("lead", "c").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
        # of two that may be linked, one at least is away from the component that most of the family is in
        homes = parts.groupBy("lead").agg(F.max_by("c", F.struct("m", "c")).alias("home"), F.sum("m").alias("m"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
        share = F.least(F.lit(DRAWN) / F.col("m"), F.lit(DRAWN_ITEMS) / F.col("n"))
        drawn = F.pmod(F.xxhash64("node", "lead"), F.lit(1 << 20)) < share * (1 << 20)
        rows = save(family.join(homes, "lead").select("lead", F.col("node").alias("id"), "c", (F.col("c") != F.col("home")).alias("away"), drawn.alias("drawn")), f"{tag}_family")
        self.fetch(rows.select(F.col("id").alias("a"), F.col("id").alias("b")), tag)
        if rows.isEmpty():
            return
        sets = rows.join(self.sets, "id")
        cores = save(sets.where("drawn").select("lead", "items").groupBy("lead").applyInArrow(_core, "lead long, core binary, seen binary, times binary"), f"{tag}_cores")
        kind = "lead long, id long, c long, away boolean, n long, w long"
        deltas = save(sets.join(cores, "lead", "left").mapInArrow(_differences(self.percent), f"{kind}, items binary"), f"{tag}_deltas")
        lows = save(deltas.groupBy("lead").agg(F.min(F.when(F.col("away"), F.col("w"))).alias("far"), F.min(F.when(~F.col("away"), F.col("w"))).alias("near"), F.min(F.struct("w", "id", "c")).alias("first")), f"{tag}_lows")
        # weights that sum to nothing or less make a link: with the least weight, if with any
        known = deltas.drop("items").join(lows, "lead")
        sure = known.where((F.col("c") != F.col("first.c")) & (F.col("w") + F.col("first.w") <= 0)).select(F.col("id").alias("x_id"), F.col("first.id").alias("y_id"))
        low = F.when(F.col("away"), F.least("far", "near")).otherwise(F.col("far"))
        posts = save(deltas.join(lows.select("lead", "far", "near"), "lead").withColumn("low", low).drop("far", "near").mapInArrow(_postings(self.percent), f"{kind}, g long, d long, at long"), f"{tag}_posts")
        role = lambda name, rows: rows.select("lead", "g", *[F.col(c).alias(f"{name}_{c}") for c in ("id", "c", "away", "n", "w", "d", "at")])
        could = (F.col("x_c") != F.col("y_c")) & (~F.col("y_away") | (F.col("x_id") < F.col("y_id")))
        could &= F.lit(twice) * F.least(F.col("x_d") - F.col("x_at"), F.col("y_d") - F.col("y_at")) >= F.col("x_w") + F.col("y_w")
        could &= F.lit(100) * F.least("x_n", "y_n") >= F.lit(self.percent) * F.greatest("x_n", "y_n")
        meet = role("x", posts.where("away")).join(role("y", posts), ["lead", "g"]).where(could).select("x_id", "y_id").unionByName(sure)
        pairs = save(meet.select(F.greatest("x_id", "y_id").alias("a"), F.least("x_id", "y_id").alias("b")).distinct(), f"{tag}_pairs")
        self.scratch.drop(*(f"{tag}_{x}" for x in ("family", "cores", "deltas", "lows", "posts")))
        if not pairs.isEmpty():
            self._take(self.verify(pairs, f"{tag}_links"), f"{tag}_c")

    def _take(self, links: DataFrame, tag: str) -> None:
        if links.isEmpty():
            return
        self.links.append(links)
        edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if self.found is not None:
            edges = edges.unionByName(self.found.select(F.col("node").alias("u"), F.col("component").alias("v")))
        self.found = self.scratch.save(components(self.scratch, edges, f"{tag}_cc"), tag)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents joined by chains of links ``100 * |A & B| >= percent * |A | B|``.

    Parameters: ``docs`` with ``doc_id`` (long) and ``text`` (string), other columns ignored; ``shingle`` words.
    Returns a row per input row: doc_id, n_shingles, component_id, kept.  Cases: null or blank texts have no
    shingle, are linked with nothing and kept; texts with fewer words than a shingle are one shingle; texts of any
    length are taken whole; a row with null doc_id is never linked, its component_id is null and kept false;
    repeated rows give repeated results; rows that share a doc_id but not the text are grouped each by its own text,
    and a group's component_id is the smallest doc_id of all its rows; no rows give no rows.
    ``percent`` is at least 80, which is what bands and bounds are laid out for.
    """
    return _grouped(docs, shingle, percent).drop("f1", "f2")


def _grouped(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``near_duplicates`` with the prints of each row's set."""
    if not 80 <= percent <= 100:
        raise ValueError("percent must be between 80 and 100")
    docs = docs.select("doc_id", "text")
    scratch = Scratch(docs.sparkSession)
    all_ = scratch.save(docs.mapInArrow(_sketched(shingle), "doc_id long, n long, f1 long, f2 long, bands array<long>, sig binary"), "sketches")
    some = all_.where("n > 0 and doc_id is not null")
    # a class of equal sets is one node of the graph, with a number of its own: one doc_id may have several texts
    equal = some.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = scratch.save(equal.withColumn("node", F.monotonically_increasing_id()), "classes")

    posts = classes.select(F.explode("bands").alias("key"), "node")
    # the leader of a bucket with several members; a bucket with one is gone here
    leaders = scratch.save(posts.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead <> last"), "leaders")
    members = scratch.save(posts.join(leaders, "key").select("key", "node", "lead"), "members")
    work = _Links(scratch, docs, classes, shingle, percent)
    stars = members.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    est = work.estimate(stars, "est_0")
    work.test(est, "test_0")

    # A bucket whose members are all in one component is done.  Else those outside the leader's component meet
    # the bucket, but the ones far from the leader need not meet the ones near it.
    comp = work.component_of
    marked = comp(comp(members.where("node <> lead").join(est.select(F.col("a").alias("node"), F.col("b").alias("lead"), "est"), ["node", "lead"], "left"), "node", "c"), "lead", "its")
    est_of = lambda test: F.coalesce(test, F.lit(False))
    kind = F.when(est_of(F.col("est") >= NEAR) & (F.col("c") == F.col("its")), 0).when(est_of(F.col("est") < FAR), 2).otherwise(1)
    marked = scratch.save(marked.select("key", "lead", "node", "c", (F.col("c") != F.col("its")).alias("out"), kind.alias("kind")), "marked")
    counts = [F.sum(test.cast("long")).alias(name) for name, test in (("loose", F.col("out")), ("mid", F.col("kind") == 1), ("far", F.col("kind") == 2))]
    open_ = marked.groupBy("key").agg(*counts, F.count("*").alias("m")).where("loose > 0 and (mid > 0 and m > 1 or far > 1)")
    rest = scratch.save(marked.join(open_.select("key", "mid"), "key").where("kind > 0 or mid > 0"), "open")
    if not rest.isEmpty():
        work.settle(scratch.save(rest.select("lead", "node", "c").distinct(), "left"), "settle")

    groups = classes.select("f1", "f2", "node", "rep")
    if work.found is not None:
        linked = scratch.save(work.found.join(groups.select("node", "rep"), "node"), "linked")
        least = linked.groupBy("component").agg(F.min("rep").alias("c"))
        groups = groups.join(linked.join(least, "component").select("node", "c"), "node", "left")
    else:
        groups = groups.withColumn("c", F.col("rep"))
    groups = groups.select("f1", "f2", F.coalesce("c", "rep").alias("c"))
    named = some.select("doc_id", "n", "f1", "f2").join(groups, ["f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), "f1", "f2")
    lone = all_.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "f1", "f2")
    out = scratch.save(named.unionByName(lone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))), "result")
    scratch.drop("sketches", "classes", "leaders", "members", "marked", "open", "est_0", "linked")
    return out


def without_near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, in its own columns, unchanged.

    Cases as in ``near_duplicates``; rows with null doc_id stay, and so do rows without words; of rows that share
    both doc_id and shingles one stays; where a doc_id has several texts, those stay whose group has no smaller
    doc_id; columns may have any names but ``_tesserae_place``, ``_tesserae_1`` and ``_tesserae_2``.
    """
    scratch = Scratch(docs.sparkSession)
    found = _grouped(docs, shingle, 80).where("doc_id is not null")
    per = scratch.save(found.groupBy("doc_id").agg(F.max("kept").alias("some"), F.count("*").alias("rows")), "per_id")
    # ids of which every row goes, and ids that have several rows, which are told apart by their texts
    listed = scratch.save(per.where("not some or rows > 1").select(F.col("doc_id").alias("id")), "listed")
    many = listed.count()
    if not many:
        return docs
    # only rows that the bitmap of listed ids lets by are shuffled to be looked up
    bits, sent = _bitmap(listed, many)
    placed = docs.withColumn("_tesserae_place", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(bits)), F.lit(0)))
    known = placed.where("doc_id is not null")
    inside, outside = (known.mapInArrow(_split(sent, x), docs.schema) for x in (True, False))
    kept = outside.unionByName(docs.where("doc_id is null")).unionByName(inside.join(listed, inside.doc_id == listed.id, "left_anti"))
    twice = scratch.save(per.where("some and rows > 1").select(F.col("doc_id").alias("id")), "twice")
    if twice.isEmpty():
        return kept
    prints = scratch.save(inside.join(twice, inside.doc_id == twice.id, "left_semi").mapInArrow(_printed(shingle), _wider(docs)), "printed")
    stay = found.where("kept and n_shingles > 0").join(twice, found.doc_id == twice.id, "left_semi").select(F.col("doc_id").alias("id"), "f1", "f2").distinct()
    one = prints.where("_tesserae_1 is not null").dropDuplicates(["doc_id", "_tesserae_1", "_tesserae_2"])
    one = one.join(stay, (one.doc_id == stay.id) & (one._tesserae_1 == stay.f1) & (one._tesserae_2 == stay.f2), "left_semi")
    return kept.unionByName(one.unionByName(prints.where("_tesserae_1 is null")).select(*[F.col(f"`{c}`") for c in docs.columns]))


def _wider(docs: DataFrame) -> StructType:
    return StructType([*docs.schema.fields, StructField("_tesserae_1", LongType()), StructField("_tesserae_2", LongType())])


def _printed(k: int):
    """Rows with the prints of their sets; nulls where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches, "text"):
            sets = [shingle_set(t, hashes, k) for t in text_bytes(b.column("text"))]
            full = np.flatnonzero([len(s) > 0 for s in sets])
            f = np.zeros((len(sets), 2), np.int64)
            if len(full):
                some = [sets[i] for i in full]
                f[full] = _prints(np.concatenate(some), np.cumsum([0, *map(len, some[:-1])]))
            blank = np.array([len(s) == 0 for s in sets], bool)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(f[:, 0], mask=blank), pa.array(f[:, 1], mask=blank)], names=[*b.schema.names, "_tesserae_1", "_tesserae_2"])

    return run
