"""Class-based n-gram scoring (Brown): exchange clustering, class transitions, word emissions.

1. Words of all training texts are counted; whole frequency classes of at most ``HOT`` words get numbers by rank.
2. Texts are written once as sequences of these numbers, other words beside them.
3. Classes come from the exchange algorithm.  The ``CORE`` most frequent words are exchanged one at a time, which
   gives the classes their start.  Then all numbered words are exchanged in rounds: executors count each word's
   neighbours by class over the whole training corpus, words are dealt out in parts, and each goes to the class
   that its own neighbours make likeliest, its own share of the counts left out.  A round is kept if it raises the
   likelihood of the class bigrams; rounds end when one raises it by less than ``GAIN`` nats a token or lowers it.
   Every other training word is then put into a class by its own neighbours in the same way; only words that the
   training texts lack have a class without a choice.
4. P(word | class before) = share * P(class | class before) * P(word | class) + (1 - share) * P(word), so the
   score of a token is log10(count + 0.5) plus a number that depends on two classes only.

What is broadcast (``HOT`` words and their classes) and what a task holds has bounds that no corpus moves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold, slices, text_bytes, words

#: Numbered words (broadcast); of them exchanged one at a time at the start, in so many passes; classes.
HOT, CORE, PASSES, CLASSES = 1 << 18, 1024, 4, 32
#: Nats a token by which a round must raise the likelihood for another one to follow.
GAIN = 5e-3
#: Weight of the class model against single words; pseudo-counts of a transition.
SHARE, BACKOFF = 0.9, 2.0
#: Words that a counting task holds before it passes them on.
HELD = 300_000
#: Words whose neighbour counts are added up in one group.
PART = 4096
#: Bytes of coded texts that are worked on together.
SLICE = 1 << 20
END = 0  # the number of the end of a text


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(count.keys()), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    for b in slices(batches, "text", 2 << 20):
        for t in text_bytes(b.column("text")):
            if t:
                count.update(words(t))
        if len(count) > HELD:
            yield out()
            count.clear()
    if count:
        yield out()


def _encoding(hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(hot.value[0], 1)}.get
        for b in slices(batches, "text"):
            ids, rare, n = [], [], []
            for t in text_bytes(b.column("text")):
                w = words(t) if t else []
                x = np.fromiter((number(v, -1) for v in w), np.int32, len(w))
                rare.append([w[i] for i in np.flatnonzero(x < 0)])
                n.append(len(w) + 1)
                ids.append(x.tobytes() + b"\0\0\0\0")
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("held_out"), b.column("train"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary()))], names=["row", "doc_id", "held_out", "train", "n_tokens", "ids", "rare"])

    return run


def _flat(b: pa.RecordBatch) -> np.ndarray:
    """All numbers of a batch in a row; each text ends with END, and an END stands in front."""
    return np.frombuffer(b"\0\0\0\0" + b"".join(b.column("ids").to_pylist()), np.int32)


def _core_pairs(core: int):
    """Counts of adjacent numbers, those from ``core`` on (and words without one) as one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((core + 1) ** 2, np.int64)
        for b in slices(batches, "ids", SLICE):
            x = _flat(b).astype(np.int64)
            x = np.where((x < 0) | (x > core), core, x)
            sums += np.bincount(x[:-1] * (core + 1) + x[1:], minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(at), "n": pa.array(sums[at])})

    return run


def exchange(pairs: np.ndarray, classes: int, passes: int = PASSES) -> np.ndarray:
    """A class for each word of a square matrix of bigram counts; the first and last word keep classes of their own.

    Words move, most frequent first, to the class where sum N(a,b) log N(a,b) - sum N(a.) log N(a.) -
    sum N(.b) log N(.b) is largest, until none moves or ``passes`` are over.  The rounds over all words follow.
    """
    v = len(pairs)
    of = np.concatenate([[classes], np.arange(v - 2) % classes, [classes + 1]])
    total = classes + 2
    left = np.zeros((v, total))  # counts of (word, class after it)
    right = np.zeros((v, total))  # counts of (class before it, word)
    for c in range(total):
        left[:, c] = pairs[:, of == c].sum(1)
        right[:, c] = pairs[of == c].sum(0)
    n = np.array([left[of == c].sum(0) for c in range(total)])
    xlogx = lambda x: x * np.log(np.maximum(x, 1))
    order = np.argsort(-pairs[1:-1].sum(1), kind="stable") + 1
    for _ in range(passes):
        moved = 0
        for w in order:
            c, self_ = of[w], pairs[w, w]
            # take w out of its class
            n[c] -= left[w]
            n[:, c] -= right[w]
            n[c, c] += self_
            rows, cols = n[:classes], n[:, :classes].T
            out, in_ = left[w].copy(), right[w].copy()
            out[c] -= self_
            in_[c] -= self_
            gain = (xlogx(rows + out) - xlogx(rows)).sum(1) + (xlogx(cols + in_) - xlogx(cols)).sum(1)
            i = np.arange(classes)
            d = n[i, i]
            gain += xlogx(d + out[i] + in_[i] + self_) - xlogx(d + out[i]) - xlogx(d + in_[i]) + xlogx(d)
            gain -= xlogx(rows.sum(1) + pairs[w].sum()) - xlogx(rows.sum(1)) + xlogx(cols.sum(1) + pairs[:, w].sum()) - xlogx(cols.sum(1))
            best = int(gain.argmax())
            if gain[best] <= gain[c] + 1e-9:
                best = c
            if best != c:
                moved += 1
                left[:, c] -= pairs[:, w]
                left[:, best] += pairs[:, w]
                right[:, c] -= pairs[w]
                right[:, best] += pairs[w]
                of[w] = best
            n[best] += left[w]
            n[:, best] += right[w]
            n[best, best] -= self_
        if not moved:
            break
    return of


def _packed(x: np.ndarray) -> bytes:
    """A sparse array of counts: places and values, four bytes each, compressed byte by byte."""
    at = np.flatnonzero(x)
    both = np.concatenate([np.diff(at, prepend=0), x[at]]).astype(np.uint32)
    return zstandard.ZstdCompressor(level=1).compress(both.view(np.uint8).reshape(-1, 4).T.tobytes())


def _add_packed(blob: bytes, out: np.ndarray) -> None:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    both = np.ascontiguousarray(both.reshape(4, -1).T).view(np.uint32).ravel()
    out[np.cumsum(both[: len(both) // 2].astype(np.int64))] += both[len(both) // 2 :]


SUMS = "part long, sums binary"


def _contexts(sent, v: int, kinds: int):
    """For each part of the numbered words the counts of the classes after and before each of them; as part -1 those of class bigrams.

    Words are dealt to the parts in turn, so that each has its share of the frequent ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, parts = sent.value, -(-v // PART)
        slot = np.arange(v) % parts * PART + np.arange(v) // parts
        sums, pairs = np.zeros(parts * PART * 2 * kinds, np.int32), np.zeros(kinds * kinds, np.int64)
        for b in slices(batches, "ids", SLICE):
            x = _flat(b)
            c = of[x]
            pairs += np.bincount(c[:-1].astype(np.int64) * kinds + c[1:], minlength=len(pairs))
            pos = np.flatnonzero(x > 0)
            at = slot[x[pos] - 1] * (2 * kinds)
            np.add.at(sums, at + c[pos + 1], np.int32(1))
            np.add.at(sums, at + kinds + c[pos - 1], np.int32(1))
        yield pa.RecordBatch.from_pydict({"part": pa.array([-1]), "sums": pa.array([pairs.tobytes()], pa.binary())})
        step = PART * 2 * kinds
        for i in range(0, len(sums), step):
            if sums[i : i + step].any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([i // step]), "sums": pa.array([_packed(sums[i : i + step])], pa.binary())})

    return run


def _added(kinds: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        part, blobs = key[0].as_py(), t.column("sums").to_pylist()
        if part < 0:
            return pa.table({"part": [part], "sums": pa.array([sum(np.frombuffer(x, np.int64) for x in blobs).tobytes()], pa.binary())})
        total = np.zeros(PART * 2 * kinds, np.int64)
        for x in blobs:
            _add_packed(x, total)
        return pa.table({"part": [part], "sums": pa.array([_packed(total)], pa.binary())})

    return run


def _gains(pairs: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """What a class gains from one more (class, next) and from one more (before, class): the slope of the likelihood."""
    n = pairs + 0.5
    return np.log(n[:classes]) - np.log(n[:classes].sum(1, keepdims=True)), np.log(n[:, :classes]) - np.log(n[:, :classes].sum(0))


def likelihood(pairs: np.ndarray) -> float:
    """Nats a token that class bigrams tell of each other."""
    xlogx = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    total = max(pairs.sum(), 1)
    return float((xlogx(pairs) - xlogx(pairs.sum(1)) - xlogx(pairs.sum(0)) + xlogx(total)) / total)


def _moves(sent, kinds: int, classes: int):
    """The best class of each word of a part, by its neighbours; its own counts are left out of its present class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, pairs = sent.value
        parts = -(-(len(of) - 2) // PART)
        after, before = _gains(pairs, classes)
        row, col = pairs.sum(1) + 0.5 * kinds, pairs.sum(0) + 0.5 * kinds
        for b in batches:
            for part, blob in zip(b.column("part").to_pylist(), b.column("sums").to_pylist(), strict=True):
                seen = np.zeros(PART * 2 * kinds, np.int64)
                _add_packed(blob, seen)
                seen = seen.reshape(PART, 2, kinds)
                now = of[1 + part : -1 : parts]
                seen = seen[: len(now)]
                gain = seen[:, 0] @ after.T + seen[:, 1] @ before
                mine = np.flatnonzero(now < classes)
                c, out, in_ = now[mine], seen[mine, 0], seen[mine, 1]
                n = out.sum(1, keepdims=True)
                own = (out * (np.log(np.maximum(pairs[c] - out, 0) + 0.5) - np.log(np.maximum(row[c][:, None] - n, 0.5)))).sum(1)
                own += (in_ * (np.log(np.maximum(pairs[:, c].T - in_, 0) + 0.5) - np.log(np.maximum(col[c][:, None] - n, 0.5)))).sum(1)
                gain[mine, c] = own
                best = gain.argmax(1)
                best[mine] = np.where(gain[mine, best[mine]] > own + 1e-9, best[mine], c)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part]), "best": pa.array([best.astype(np.int16).tobytes()], pa.binary())})

    return run


TOKENS = "row long, train boolean, at int, word binary, prev int, next int"


def _rare_tokens(sent):
    """Each word without a number: its row and place there, and the classes beside it (the last kind: a word without a number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        for b in slices(batches, "ids", SLICE):
            x = _flat(b)
            c, pos, ends = of[x].astype(np.int32), np.flatnonzero(x < 0), np.flatnonzero(x == END)
            if len(pos):
                in_row = np.searchsorted(ends, pos) - 1
                cols = (np.asarray(b.column("row"))[in_row], b.column("train").take(pa.array(in_row)), (pos - ends[in_row]).astype(np.int32), b.column("rare").flatten(), c[pos - 1], c[pos + 1])
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names=["row", "train", "at", "word", "prev", "next"])

    return run


def _placing(sent, classes: int):
    """Word, count and class of each word of a partition whose rows are ordered by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, before = sent.value
        held: tuple[bytes, int, np.ndarray] | None = None
        out = lambda w, n, g: pa.RecordBatch.from_pydict({"word": pa.array(w, pa.binary()), "n": pa.array(n, pa.int64()), "c": pa.array(np.asarray(g).argmax(1).astype(np.int32))})
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column("word").dictionary_encode()
            names, code = coded.dictionary.to_pylist(), np.asarray(coded.indices)
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            gain = np.add.reduceat(after.T[np.asarray(b.column("next"))] + before[np.asarray(b.column("prev"))], first, axis=0)
            many = np.diff(np.concatenate([first, [len(code)]]))
            if held is not None:
                if held[0] == names[0]:
                    many[0] += held[1]
                    gain[0] += held[2]
                else:
                    yield out([held[0]], [held[1]], [held[2]])
            if len(names) > 1:
                yield out(names[:-1], many[:-1], gain[:-1])
            held = (names[-1], int(many[-1]), gain[-1].copy())
        if held is not None:
            yield out([held[0]], [held[1]], [held[2]])

    return run


def _numbered_pairs(sent, kinds: int):
    """Counts of class bigrams of which neither word lacks a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sums = sent.value, np.zeros(kinds * kinds, np.int64)
        for b in slices(batches, "ids", SLICE):
            x = _flat(b)
            c = of[x].astype(np.int64)
            sums += np.bincount((c[:-1] * kinds + c[1:])[(x[:-1] >= 0) & (x[1:] >= 0)], minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(at), "n": pa.array(sums[at])})

    return run


def _beside(b: pa.RecordBatch, kinds: int) -> tuple[np.ndarray, ...]:
    """(row index, count, class, class before, class after or -1 if a later row of these counts that pair) of the rare tokens of ``b``, in order."""
    lists = b.column("tokens")
    flat = lists.flatten()
    at, c, n, prev, next_ = (np.asarray(flat.field(k)) for k in ("at", "c", "n", "prev", "next"))
    of = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))
    o = np.lexsort((at, of))
    c, n, prev, next_ = c[o], n[o], prev[o].copy(), next_[o]
    after_rare = np.flatnonzero(prev == kinds - 1)
    prev[after_rare] = c[after_rare - 1]
    return of, n, c, prev, np.where(next_ == kinds - 1, -1, next_)


def _rare_pairs(kinds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(kinds * kinds, np.int64)
        for b in batches:
            _, _, c, prev, next_ = _beside(b, kinds)
            last = next_ >= 0
            sums += np.bincount(prev * kinds + c, minlength=len(sums)) + np.bincount((c * kinds + next_)[last], minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(at), "n": pa.array(sums[at])})

    return run


def _rare_scoring(sent, kinds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term = sent.value
        for b in batches:
            of, n, c, prev, next_ = _beside(b, kinds)
            value = term[prev, c] + np.where(next_ >= 0, term[c, next_], 0.0)
            add = lambda x: pa.array(np.bincount(of, x, b.num_rows))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([b.column("row"), add(np.log10(n + 0.5)), add(value), pa.array(np.bincount(of, n > 0, b.num_rows).astype(np.int64))], names=["row", "rare_logs", "rare_terms", "rare_known"])

    return run


def _scoring(sent):
    """Sums over the numbered words of log10(count + 0.5), over their pairs of the class term, and known tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, term, logs = sent.value
        for b in slices(batches, "ids", SLICE):
            x = _flat(b)
            c = of[x]
            at = np.flatnonzero(x == END)[:-1] + 1
            value = np.where((x[:-1] >= 0) & (x[1:] >= 0), term[c[:-1], c[1:]], 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("row", "doc_id", "held_out", "n_tokens")), pa.array(np.add.reduceat(logs[x], at)), pa.array(np.add.reduceat(np.concatenate([[0.0], value]), at)), pa.array(np.add.reduceat((x >= 0).astype(np.int64), at))], names=["row", "doc_id", "held_out", "n_tokens", "logs", "terms", "known"])

    return run


class ClassModel:
    """What is learned from the training rows of ``docs``, and the coded rows of all of them.

    names, times: the numbered words and their counts, the end of a text first; of: their classes, the last place
    for words without a number; rare: (word, n, c) of the other training words; term: the class part of a score.
    """

    def __init__(self, docs: DataFrame, share: float):
        spark = docs.sparkSession
        self.scratch, send = Scratch(spark), spark.sparkContext.broadcast
        rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "text").withColumn("train", ~F.col("held_out"))
        counts = self.scratch.save(rows.where("train").select("text").mapInArrow(_counting, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
        level = F.floor(F.log2("n") * 16)
        levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).orderBy(F.desc("level")).collect()
        fit = [r.level for r, total in zip(levels, np.cumsum([r.words for r in levels]), strict=True) if total <= HOT]
        self.texts = rows.where("train").count()
        self.types, self.tokens = sum(r.words for r in levels) + (self.texts > 0), sum(r.tokens for r in levels) + self.texts
        hot = counts.where(level >= (fit[-1] if fit else 1 << 20)).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
        self.scratch.drop("counts")
        self.names, self.times = hot.column("word").to_pylist(), np.concatenate([[self.texts], hot.column("n").to_numpy()]).astype(np.float64)
        numbered = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "train", "text")
        self.coded = self.scratch.save(numbered.mapInArrow(_encoding(send((self.names,))), "row long, doc_id long, held_out boolean, train boolean, n_tokens long, ids binary, rare array<binary>"), "coded")
        v = len(self.names)
        self.classes = max(1, min(CLASSES, v))
        self.kinds = self.classes + 2  # exchanged classes; the end; words without a number, and in the end words never seen
        self.of = np.full(v + 2, self.kinds - 1, np.int16)
        self.of[END] = self.classes
        pairs = self._exchange(v) if v else np.zeros((self.kinds, self.kinds))
        self._place(pairs)
        self._terms(share)

    def _exchange(self, v: int) -> np.ndarray:
        """Sets ``of``; returns the class bigrams that go with it."""
        send = self.coded.sparkSession.sparkContext.broadcast
        trained, core = self.coded.where("train").select("ids"), min(CORE, v)
        got = trained.mapInArrow(_core_pairs(core + 1), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        pairs = np.zeros((core + 2) ** 2)
        pairs[got.column("pair").to_numpy()] = got.column("n").to_numpy()
        self.of[1 : core + 1] = exchange(pairs.reshape(core + 2, core + 2), self.classes)[1:-1]
        best: tuple[float, np.ndarray, np.ndarray] | None = None
        self.rounds: list[float] = []
        while True:
            k = len(self.rounds)
            seen = trained.mapInArrow(_contexts(send(self.of), v, self.kinds), SUMS).groupBy("part").applyInArrow(_added(self.kinds), SUMS)
            seen = self.scratch.save(seen, f"seen_{k}")
            pairs = np.frombuffer(seen.where("part < 0").first().sums, np.int64).reshape(self.kinds, self.kinds).astype(np.float64)
            self.rounds.append(likelihood(pairs))
            gained = self.rounds[-1] - (best[0] if best else -np.inf)
            if gained > 0:
                best = (self.rounds[-1], self.of.copy(), pairs)
            if gained < GAIN:
                self.scratch.drop(f"seen_{k}")
                break
            for r in seen.where("part >= 0").mapInArrow(_moves(send((self.of, pairs)), self.kinds, self.classes), "part long, best binary").collect():
                self.of[1 + r.part : -1 : -(-v // PART)] = np.frombuffer(r.best, np.int16)
            self.scratch.drop(f"seen_{k}")
        self.of = best[1]
        return best[2]

    def _place(self, pairs: np.ndarray) -> None:
        """Puts words without a number into classes, and their tokens, with their classes, together by row."""
        send = self.coded.sparkSession.sparkContext.broadcast
        some = self.coded.where(F.size("rare") > 0).select("row", "train", "ids", "rare")
        # no word without a number has more than one token in HOT, so that no partition is hot
        tokens = some.where("train").mapInArrow(_rare_tokens(send(self.of)), TOKENS).select("word", "prev", "next").repartition("word").sortWithinPartitions("word")
        self.rare = self.scratch.save(tokens.mapInArrow(_placing(send(_gains(pairs, self.classes)), self.classes), "word binary, n long, c int"), "rare")
        tokens = some.mapInArrow(_rare_tokens(send(self.of)), TOKENS).join(self.rare, "word", "left")
        token = F.struct("at", F.coalesce("c", F.lit(self.kinds - 1)).alias("c"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), "prev", "next")
        self.looked = self.scratch.save(tokens.groupBy("row").agg(F.first("train").alias("train"), F.collect_list(token).alias("tokens")), "looked")

    def _terms(self, share: float) -> None:
        send = self.coded.sparkSession.sparkContext.broadcast
        kinds = self.kinds
        got = self.coded.where("train").select("ids").mapInArrow(_numbered_pairs(send(self.of), kinds), "pair long, n long")
        got = got.unionByName(self.looked.where("train").mapInArrow(_rare_pairs(kinds), "pair long, n long")).groupBy("pair").agg(F.sum("n").alias("n")).collect()
        moves = np.zeros(kinds * kinds)
        for r in got:
            moves[r.pair] = r.n
        moves = moves.reshape(kinds, kinds)
        of = self.of[:-1]
        in_class, types_of = np.bincount(of, self.times, kinds), np.bincount(of, minlength=kinds).astype(np.float64)
        for r in self.rare.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
            in_class[r.c] += r.n
            types_of[r.c] += r.types
        types_of[kinds - 1] += 1  # the unseen word
        self.whole = self.tokens + 0.5 * (self.types + 1)
        room = in_class + 0.5 * types_of
        p = (moves + BACKOFF * room / room.sum()) / (moves.sum(1, keepdims=True) + BACKOFF)
        self.moves, self.room = moves, room
        self.term = np.log10(share * p / np.maximum(room, 0.5) + (1 - share) / self.whole)


def score_texts(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): n_tokens, n_known, train_tokens, base_score, score, held_out,
    perplexity (10 to the score a token, negated).

    The model learns from all rows whose crc32(doc_id) modulo 5 is not 1.  A text's tokens are its words and one
    end.  Cases: a null or empty text is one end; texts of any length are scored whole; a null doc_id is learned from
    and not held out; repeated rows count and are scored each; words of one frequency are numbered in their own
    order, and a word that two classes gain alike goes to the first; with nothing to learn from, every word is unseen
    and counts are zero; other columns are ignored; no rows give no rows.
    """
    return scored(ClassModel(docs, share))


def scored(m: ClassModel) -> DataFrame:
    """``score_texts`` of the rows that the model has coded."""
    send = m.coded.sparkSession.sparkContext.broadcast
    logs = np.log10(np.concatenate([m.times, [0.5]]) + 0.5)
    logs[-1] = 0.0  # words without a number are added from their own table
    done = m.coded.select("row", "doc_id", "held_out", "n_tokens", "ids").mapInArrow(_scoring(send((m.of, m.term, logs))), "row long, doc_id long, held_out boolean, n_tokens long, logs double, terms double, known long")
    rare = m.looked.select("row", "tokens").mapInArrow(_rare_scoring(send(m.term), m.kinds), "row long, rare_logs double, rare_terms double, rare_known long")
    logged, terms = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)), F.col("terms") + F.coalesce("rare_terms", F.lit(0.0))
    ends = F.lit(int(m.texts == 0))  # the end is unseen too where nothing was learned
    return done.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") - ends + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(m.tokens)).cast("long").alias("train_tokens"),
        (logged - F.col("n_tokens") * float(np.log10(m.whole))).alias("base_score"), (logged + terms).alias("score"),
        F.pow(F.lit(10.0), -(logged + terms) / F.col("n_tokens")).alias("perplexity"),
    )
