"""Answers in passages, hits among the first k, and word overlap of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens by which an answer is looked up before it is compared as a whole.
HEAD = 3


def answer_hits(items: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, doc_id): texts (doc_id, t) whose tokens hold the item's (item_id, answer) in one run.

    Runs of as many tokens as an answer's head has are matched by an equality, and the whole answer is compared
    only where its head was met.  An item without tokens is in every text.
    """
    heads = items.withColumns({"m": F.least(F.size("answer"), F.lit(HEAD)), "head": F.slice("answer", 1, HEAD)})
    lengths = F.sequence(F.lit(1), F.least(F.size("t"), F.lit(HEAD)))
    runs = texts.where("size(t) > 0").select("doc_id", "t", F.explode(lengths).alias("m"))
    runs = runs.select("doc_id", "m", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("t") - F.col("m") + 1), lambda i: F.slice("t", i, F.col("m")))).alias("at", "head"))
    met = runs.join(heads.where("m > 0").select("item_id", "m", "head", "answer"), ["m", "head"]).select("item_id", "doc_id", "at", "answer")
    whole = met.join(texts, "doc_id").where(F.slice("t", F.col("at") + 1, F.size("answer")) == F.col("answer")).select("item_id", "doc_id").distinct()
    empty = items.where(F.size("answer") == 0).select("item_id", F.lit(1).alias("one")).join(texts.select("doc_id", F.lit(1).alias("one")), "one").select("item_id", "doc_id")
    return whole.unionByName(empty)


def hits_by_k(first: DataFrame, places: DataFrame, ks: list[int]) -> DataFrame:
    """(k, hits): how many of ``first`` (one doc_id an item) stand below place k of ``places`` (doc_id, nr); k beyond the last place is left out."""
    found = first.join(places, "doc_id").agg(*[F.count_if(F.col("nr") < k).alias(f"h{k}") for k in ks])
    size = places.agg(F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"h{k}").alias("hits")) for k in ks])
    return found.join(size).select("n", F.inline(each)).where("k <= n").select("k", "hits")


def shared_word_jaccard(bags: DataFrame) -> DataFrame:
    """(a, b, jac) of pairs a < b of (item_id, w: distinct words) with a word in common, met by their words."""
    size = F.size("w")
    x = bags.select(F.col("item_id").alias("a"), size.alias("na"), F.explode("w").alias("word"))
    y = bags.select(F.col("item_id").alias("b"), size.alias("nb"), F.explode("w").alias("word"))
    same = x.join(y, "word").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return same.select("a", "b", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jac"))
