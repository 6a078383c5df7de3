"""Text functions and answer metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a token is, the ASCII punctuation, the articles.
TOKEN = r"([\p{L}\p{N}\p{M}]+)|([^\p{Z}\p{C}])"
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
ARTICLES = r"(?U)\b(a|an|the)\b"


def tokens(text: Column, lower: bool = True) -> Column:
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.transform(found, F.lower) if lower else found


def normalised_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, articles to spaces, single spaces."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, ARTICLES, " "), r"\s+", " "))


def has_answer(answers: Column, text_tokens: Column) -> Column:
    """Whether some answer's token list is a contiguous part of the text's; an empty answer always is."""
    m = lambda a: F.size(a)
    at = lambda a: F.sequence(F.lit(1), F.size(text_tokens) - m(a) + 1)
    inside = lambda a: F.exists(at(a), lambda i: F.slice(text_tokens, i, m(a)) == a)
    return F.exists(answers, lambda a: F.when(m(a) == 0, True).when(m(a) > F.size(text_tokens), False).otherwise(inside(a)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def edit_similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a non-empty part."""
    return ((F.length(text) - F.length(F.replace(text, part))) / F.length(part)).cast("long")


def inversions(ranks: Column) -> Column:
    """Pairs i < j with ranks[i] > ranks[j]."""
    at = F.sequence(F.lit(1), F.size(ranks))
    over = lambda i: F.size(F.filter(F.slice(ranks, i, F.size(ranks)), lambda y: y < F.element_at(ranks, i)))
    return F.aggregate(at, F.lit(0), lambda s, i: s + over(i))


def bit_length(x: Column) -> Column:
    return F.ceil(F.log2(x + 1)).cast("long")


def padded(ids: Column, n: int, fill: int) -> Column:
    """Cut or filled on the right to n elements."""
    cut = F.slice(ids, 1, n)
    return F.concat(cut, F.array_repeat(F.lit(fill).cast("int"), F.greatest(F.lit(n) - F.size(cut), F.lit(0))))


def windows(ids: Column, block: int, stride: int, pad: int) -> Column:
    """Sliding token blocks: array of (input_ids, labels); every token is labelled once, others are -100."""
    total = F.when(F.size(ids) >= block, F.floor(F.size(ids) / block).cast("int") * block).otherwise(F.size(ids))
    starts = F.when(total > 0, F.sequence(F.lit(0), total - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))

    def window(i: Column) -> Column:
        begin, end = F.greatest(i + stride - block, F.lit(0)), F.least(i + stride, total)
        part = F.slice(ids, begin + 1, end - begin)
        hidden = F.size(part) - (end - i)
        labels = F.concat(F.array_repeat(F.lit(-100), hidden), F.slice(part, hidden + 1, end - i))
        room = F.lit(block) - F.size(part)
        return F.struct(F.concat(part, F.array_repeat(F.lit(pad), room)).alias("input_ids"), F.concat(labels, F.array_repeat(F.lit(-100), room)).alias("labels"))

    return F.transform(starts, window)


def mask(ids: Column, n: int) -> Column:
    """1 for each of the first n elements, 0 for what ``padded`` fills in."""
    return padded(F.transform(F.slice(ids, 1, n), lambda x: F.lit(1)), n, 0)


def prompt(prefix: str, text: Column, end: str = "") -> Column:
    return F.concat(F.lit(prefix), text, F.lit(end))


def target_text(target: Column, answers: Column, choice: Column, end: str = " </s>") -> Column:
    """The target and the end mark; without a target the answer that ``choice`` picks; without answers null."""
    picked = F.when(F.size(answers) > 0, F.element_at(answers, (F.pmod(choice, F.size(answers)) + 1).cast("int")))
    return F.concat(F.coalesce(target, picked), F.lit(end))


def block_size(model_max: Column, most: int = 1024) -> Column:
    return F.least(model_max, F.lit(most))


def truncated(ids: Column, n: int, mode: str) -> Column:
    """What is left of a sequence beside the special tokens: the head of n - 4 for an encoder, the tail of n - 3 for a
    decoder, the head of n - 5 for both."""
    if mode == "decoder":
        return F.when(F.size(ids) > n - 3, F.slice(ids, -(n - 3), n - 3)).otherwise(ids)
    return F.slice(ids, 1, n - {"encoder": 4, "encoder_decoder": 5}[mode])


def perplexity(mean_loss: Column) -> Column:
    """exp, infinite where it overflows."""
    return F.exp(mean_loss)


def warm_up(step: Column, warm: int, total: int, low: float) -> Column:
    """Linear warm-up from ``low`` to 1, then linear decay to ``low`` at ``total``."""
    up = (1 - low) * step / warm + low
    down = F.greatest(F.lit(0.0), 1 + (low - 1) * (step - warm) / (total - warm))
    return F.when(step < warm, up).otherwise(down)
