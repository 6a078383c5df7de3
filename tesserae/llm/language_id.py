"""Language identification: script ranges narrow candidates, then Viterbi over per-word scores.

A word's score in a language is the scaled sum of the log probabilities of its byte n-grams (2 to 4 bytes, word
boundaries included), relative to the mean over languages.  Languages that do not use the word's script are out.
Viterbi with a switching penalty labels spans; a text's language is the one with most letters, its score their
share.  Everything is computed on flat byte arrays, and documents walk through Viterbi side by side.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import fold, slices, text_bytes

#: Expected documents a language in the sample that the model is fitted on (the only bound of the fit), and languages
#: that a model can tell apart; more raise ValueError.
FIT_DOCS, LANGUAGES = 3000, 256
BUCKETS, ORDERS = 1 << 16, (2, 3, 4)
#: Scale and cut of a word's scores, penalty of a change of language, and of a language without the word's script.
SCALE, CUT, SWITCH, FOREIGN = 0.4, 8.0, 6.0, 30.0
#: Least share of a language's letters that makes a script one of its own.
OWN_SCRIPT = 0.01
#: Bytes scored together, and bytes of the texts that walk together.
CHUNK, WALK = 1 << 18, 4 << 20
#: First code points of scripts outside Latin, by Unicode block; "" where letters go back to Latin.
SCRIPTS = [
    (0x000, ""), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "Syriac"), (0x780, "Thaana"),
    (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Gurmukhi"), (0xA80, "Gujarati"), (0xB00, "Oriya"), (0xB80, "Tamil"), (0xC00, "Telugu"), (0xC80, "Kannada"),
    (0xD00, "Malayalam"), (0xD80, "Sinhala"), (0xE00, "Thai"), (0xE80, "Lao"), (0xF00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1E00, ""), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"), (0x3100, "Han"),
    (0xA000, "Yi"), (0xA700, ""), (0xAC00, "Hangul"), (0xF900, "Han"), (0xFB00, ""), (0x20000, "Han"),
]
_STARTS = [a for a, _ in SCRIPTS]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)  # bytes that start a letter, nearly: ASCII letters and leads of letter blocks
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xE2), *range(0xE3, 0xEF), 0xF0]] = True
_HARD = np.zeros(256, bool)  # leads of letters outside Latin
_HARD[[*range(0xCD, 0xE2), *range(0xE3, 0xEF), 0xF0]] = True


def script(word: bytes) -> str:
    """The script of the word's first letter."""
    for ch in word.decode("utf-8", "ignore"):
        if ch.isalpha():
            return SCRIPTS[bisect_right(_STARTS, ord(ch)) - 1][1]
    return ""


def buckets(flat: np.ndarray, space: np.ndarray) -> list[np.ndarray]:
    """For each order the bucket of the n-gram at each byte; BUCKETS where there is none."""
    b, n = flat.astype(np.uint32), len(flat)
    out = []
    for order in ORDERS:
        g = np.full(n, BUCKETS, np.int32)
        m = n - order + 1
        if m > 0:
            h = b[:m].copy()
            for j in range(1, order):
                h = h * np.uint32(256 if order == 2 else 65599) + b[j : m + j]
            if order > 2:
                h = h * np.uint32(2654435761) >> np.uint32(16)
            # white space may only be the first or the last byte, and not both
            fine = ~(space[:m] & space[order - 1 :]) if order == 2 else ~space[1 : m + 1]
            for j in range(2, order - 1):
                fine &= ~space[j : m + j]
            g[:m] = np.where(fine, h.astype(np.int32), BUCKETS)
        out.append(g)
    return out


def pieces(text: bytes, most: int = CHUNK) -> Iterator[bytes]:
    """The text in parts of at most about ``most`` bytes, cut at white space where there is some."""
    at = 0
    while len(text) - at > most:
        end = max(text.rfind(b" ", at, at + most), text.rfind(b"\n", at, at + most)) + 1
        end = end if end > at else at + most
        yield text[at:end]
        at = end
    yield text[at:]


@dataclass
class Model:
    langs: list[str]
    tables: list[np.ndarray]  # for each order (BUCKETS + 1, languages), float32; the last row is zero
    scripts: dict[str, np.ndarray]  # script -> which languages have it as their own


def word_scores(model: Model, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, letters, first byte) of each word of the flat bytes, which begin with white space."""
    space = _SPACE[flat]
    starts = np.flatnonzero(~space[1:] & space[:-1])  # the white space before each word
    if not len(starts):
        return np.zeros((0, len(model.langs)), np.float32), np.zeros(0, np.int64), starts
    total = sum(np.take(t, g, axis=0) for t, g in zip(model.tables, buckets(flat, space), strict=True))
    scores = np.add.reduceat(total, starts, axis=0) * np.float32(SCALE)
    np.clip(scores, -CUT, CUT, out=scores)
    letters = np.add.reduceat(_LETTER[flat].astype(np.int64), starts)
    scores[letters == 0] = 0
    for i in np.flatnonzero(np.add.reduceat(_HARD[flat].astype(np.int64), starts)):
        end = starts[i + 1] if i + 1 < len(starts) else len(flat)
        own = model.scripts.get(script(flat[starts[i] : end].tobytes()))
        if own is not None and own.any():
            scores[i, ~own] -= FOREIGN
    return scores, letters, starts


def viterbi(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best label of every word; documents are runs ``starts[d] .. + sizes[d]`` of words, walked side by side."""
    labels = np.zeros(len(scores), np.int16)
    o = np.argsort(-sizes, kind="stable")
    o = o[sizes[o] > 0]
    if not len(o):
        return labels
    first, size = starts[o], sizes[o]
    own = np.arange(scores.shape[1], dtype=np.int16)
    back = np.zeros(scores.shape, np.int16)
    now = scores[first].astype(np.float64)
    live = np.searchsorted(-size, -np.arange(size[0]), "left")  # documents with more than t words
    for t in range(1, size[0]):
        n = live[t]
        at, was = first[:n] + t, now[:n]
        top = was.argmax(1).astype(np.int16)
        change = was[np.arange(n), top] - penalty
        stay = was >= change[:, None]
        back[at] = np.where(stay, own, top[:, None])
        now[:n] = np.where(stay, was, change[:, None]) + scores[at]
    label = now.argmax(1).astype(np.int16)
    for t in range(size[0] - 1, -1, -1):
        n = live[t]
        at = first[:n] + t
        labels[at] = label[:n]
        label[:n] = back[at, label[:n]]
    return labels


def _lowered(column: pa.Array) -> list[bytes | None]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return text_bytes(pc.utf8_lower(column))


def spans_of(label: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, label, first word, words) of each run of one label inside a document."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    first = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (of[1:] != of[:-1])])) if len(label) else np.zeros(0, np.int64)
    starts = np.cumsum(sizes) - sizes
    return of[first], label[first], first - starts[of[first]], np.diff(np.concatenate([first, [len(label)]]))


def labelled(model: Model, texts: list[bytes | None], with_spans: bool = True) -> tuple[list[str], list[float], list[list[dict]]]:
    """Language, score and spans of each lower-cased text; a span has lang, first_word and n_words."""
    sizes, parts, weights = np.zeros(len(texts), np.int64), [], []
    group, held = [], 0

    def flush() -> None:
        nonlocal group, held
        if group:
            flat = np.frombuffer(b" " + b" ".join(p for _, p in group) + b" ", np.uint8)
            s, w, first = word_scores(model, flat)
            ends = np.cumsum([len(p) + 1 for _, p in group])
            per = np.diff(np.searchsorted(first, np.concatenate([[0], ends]), "left"))
            np.add.at(sizes, [d for d, _ in group], per)
            parts.append(s)
            weights.append(w)
            group, held = [], 0

    for d, text in enumerate(texts):
        for p in pieces(text or b""):
            group.append((d, p))
            held += len(p)
            if held >= CHUNK:
                flush()
    flush()
    langs = len(model.langs)
    scores = np.concatenate(parts) if parts else np.zeros((0, langs), np.float32)
    letters = np.concatenate(weights) if weights else np.zeros(0, np.int64)
    starts = np.cumsum(sizes) - sizes
    label = viterbi(scores, starts, sizes)
    share = np.bincount(np.repeat(np.arange(len(texts)), sizes) * langs + label, letters, len(texts) * langs).reshape(-1, langs)
    total = share.sum(1)
    best = share.argmax(1)
    names, points = [], []
    spans: list[list[dict]] = [[] for _ in texts]
    for d, x, at, n in zip(*(v.tolist() for v in spans_of(label, sizes)), strict=True) if with_spans else ():
        spans[d].append({"lang": model.langs[x], "first_word": at, "n_words": n})
    for d, text in enumerate(texts):
        ascii_letter = total[d] > 0
        if not text or not ascii_letter and not any(c.isalpha() for c in text.decode()) or ascii_letter and not _has_letter(text):
            names.append("und")
            points.append(0.0)
            spans[d] = []
        else:
            names.append(model.langs[best[d]])
            points.append(float(share[d, best[d]] / total[d]) if total[d] else 1.0 / langs)
    return names, points, spans


def _has_letter(text: bytes) -> bool:
    """Whether some character is a letter; texts nearly always show one in their first bytes."""
    return any(65 <= c <= 90 or 97 <= c <= 122 for c in text[:64]) or any(c.isalpha() for c in text.decode())


def _counts():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        scripts: dict[tuple[str, str], int] = {}
        for b in slices(batches, "text"):
            for lang, text in zip(b.column("lang").to_pylist(), _lowered(b.column("text")), strict=True):
                table = sums.setdefault(lang, np.zeros((len(ORDERS), BUCKETS + 1), np.int64))
                for p in pieces(text or b""):
                    flat = np.frombuffer(b" " + p + b" ", np.uint8)
                    for k, g in enumerate(buckets(flat, _SPACE[flat])):
                        table[k] += np.bincount(g, minlength=BUCKETS + 1)
                hard = [w for w in (text or b"").split() if _HARD[np.frombuffer(w, np.uint8)].any()] if text and _HARD[np.frombuffer(text, np.uint8)].any() else []
                found = [script(w) for w in hard]
                for s, n in [(s, found.count(s)) for s in set(found)] + [("", len((text or b"").split()) - len(hard))]:
                    scripts[lang, s] = scripts.get((lang, s), 0) + n
        rows = [(lang, f"#{s}", 0, n) for (lang, s), n in scripts.items()]
        for lang, table in sums.items():
            for k in range(len(ORDERS)):
                at = np.flatnonzero(table[k, :BUCKETS])
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "kind": pa.array([str(k)] * len(at), pa.string()), "bucket": pa.array(at), "n": pa.array(table[k, at])})
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], names=["lang", "kind", "bucket", "n"])

    return run


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model | None:
    """The model of the rows of ``docs`` with text and lang, from a sample of about ``fit_docs`` a language."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    if len(langs) > LANGUAGES:
        raise ValueError(f"{len(langs)} languages are more than {LANGUAGES}")
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, fit_docs / sizes[lang])))])
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    rows = sample.select("text", "lang").mapInArrow(_counts(), "lang string, kind string, bucket long, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    place = {lang: i for i, lang in enumerate(langs)}
    tables, scripts = [], {}
    for k in range(len(ORDERS)):
        c = np.zeros((BUCKETS, len(langs)))
        r = rows[rows.kind == str(k)]
        c[r.bucket.to_numpy(), r.lang.map(place).to_numpy(int)] = r.n.to_numpy()
        p = np.log(c + 0.5) - np.log(c.sum(0) + 0.5 * BUCKETS)
        tables.append(np.vstack([p - p.mean(1, keepdims=True), np.zeros((1, len(langs)))]).astype(np.float32))
    r = rows[rows.kind.str.startswith("#")]
    total = r.groupby("lang").n.sum()
    for lang, kind, n in zip(r.lang, r.kind, r.n, strict=True):
        if n >= OWN_SCRIPT * total[lang] and n:
            scripts.setdefault(kind[1:], np.zeros(len(langs), bool))[place[lang]] = True
    return Model(langs, tables, scripts)


SPANS = "array<struct<lang:string,first_word:int,n_words:int>>"
_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))


def _predicting(sent, extra: list[str], keep: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in slices(batches, "text", WALK):
            texts = _lowered(b.column("text"))
            names, points, spans = labelled(model, texts, keep is None) if model else (["und"] * len(texts), [0.0] * len(texts), [[]] * len(texts))
            if keep is None:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in extra), pa.array(names, pa.string()), pa.array(points, pa.float64()), pa.array(spans, _SPANS)], names=[*extra, "lang_pred", "score", "spans"])
            else:
                yield b.filter(pa.array([n != "und" and p >= keep for n, p in zip(names, points, strict=True)], pa.bool_()))

    return run


def _fitted(docs: DataFrame, fit_docs: int):
    ship(docs.sparkSession)
    model = fit(docs.where(fold(F.col("doc_id")) != 0), fit_docs)
    return docs.sparkSession.sparkContext.broadcast(model)


def identify(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans of every row of ``docs`` (doc_id, text, lang).

    Learns from rows whose crc32(doc_id) modulo 5 is not 0.  The broadcast model has 3 * 2**16 numbers a language,
    of at most ``LANGUAGES``.  ``spans`` are the runs of words (by white space, from 0) that Viterbi gives one
    language.  Cases: null texts and texts without a letter are ``und`` with score 0 and no span, and so is everything
    where no row has a language; null langs teach nothing; null doc_ids teach nothing and are not held out; texts of
    any length are walked whole, very long ones scored in parts; repeated rows give repeated results; ties go to the
    language that sorts first; other columns are ignored; no rows give no rows.
    """
    rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_predicting(_fitted(docs, fit_docs), ["doc_id", "held_out"], None), f"doc_id long, held_out boolean, lang_pred string, score double, spans {SPANS}")


def identified_only(docs: DataFrame, least: float = 0.3, fit_docs: int = FIT_DOCS) -> DataFrame:
    """The rows of ``docs`` with a language that has at least the share ``least`` of the letters; cases as in ``identify``."""
    return docs.mapInArrow(_predicting(_fitted(docs, fit_docs), [], least), docs.schema)
