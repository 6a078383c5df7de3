"""Readers and writers of the pipeline's records."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The names under which tasks, languages and settings are known.
TASKS = {"r": "retrieval", "retrieval": "retrieval", "c": "completion", "completion": "completion", "p": "pipeline", "pipeline": "pipeline"}
LANGUAGES = {"py": "python", "python": "python", "java": "java"}
SETTINGS = {"xf-f": "cross_file_first", "cross_file_first": "cross_file_first", "xf-r": "cross_file_random", "cross_file_random": "cross_file_random", "if": "in_file", "in_file": "in_file"}


@F.pandas_udf(StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFD", t), na_action="ignore")


def nfd(text: Column) -> Column:
    """Canonical decomposition, for which Spark has no function; in Arrow batches."""
    return _decomposed(text)


def load_samples(spark: SparkSession, root: str, task: str, language: str, settings: str | list[str]) -> DataFrame:
    """Samples of a Hive-partitioned folder (task, language, setting); only the wanted partitions are read."""
    names = [settings] if isinstance(settings, str) else list(settings)
    for value, known, what in ((task.lower(), TASKS, "task"), (language.lower(), LANGUAGES, "language"), *((n.lower(), SETTINGS, "setting") for n in names)):
        if value not in known:
            raise ValueError(f"unknown {what}: {value}")
    wanted = [SETTINGS[n.lower()] for n in names]
    if TASKS[task.lower()] == "retrieval" and "in_file" in wanted:
        raise ValueError("retrieval has no in_file setting")
    return spark.read.parquet(root).where((F.col("task") == TASKS[task.lower()]) & (F.col("language") == LANGUAGES[language.lower()]) & F.col("setting").isin(wanted))


def load_examples(rows: DataFrame, rank: int = -1, world: int = 1) -> DataFrame:
    """(k, id, ctxs) of examples numbered by k: shard k mod world, default id k, default score 1 / (k + 1)."""
    rows = rows if rank < 0 else rows.where(F.pmod("k", F.lit(world)) == rank)
    score = lambda c: F.struct(c["text"].alias("text"), F.coalesce(c["score"], 1 / (F.col("k") + 1)).alias("score"))
    return rows.withColumns({"id": F.coalesce("id", F.col("k").cast(rows.schema["id"].dataType)), "ctxs": F.transform("ctxs", score)})


def load_passages(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, title) of a TSV file; rows that start with ``id`` and rows with fewer fields are skipped."""
    raw = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    return raw.where((F.size("f") >= 3) & (F.get("f", F.lit(0)) != "id")).select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(("id", "text", "title"))])


def read_examples(spark: SparkSession, path: str, rank: int = -1, world: int = 1) -> DataFrame:
    """``load_examples`` of a JSON Lines file, or of a file with one JSON list, numbered in its order from 0."""
    from ..operators.numbering import numbered

    whole = not path.endswith(".jsonl")
    rows = spark.read.option("multiLine", whole).schema("id string, question string, target string, answers array<string>, ctxs array<struct<text:string,score:double>>").json(path)
    order = rows.withColumn("_place", F.monotonically_increasing_id())
    return load_examples(numbered(order, "_place", name="k").drop("_place"), rank, world)


def write_graph(nodes: DataFrame, edges: DataFrame, root: str) -> None:
    """Nodes and edges as Parquet, partitioned by repo."""
    nodes.write.mode("overwrite").partitionBy("repo").parquet(f"{root}/nodes")
    edges.write.mode("overwrite").partitionBy("repo").parquet(f"{root}/edges")


def read_graph(spark: SparkSession, root: str, repos: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``write_graph``; only the partitions of ``repos`` are read."""
    nodes, edges = (spark.read.parquet(f"{root}/{name}") for name in ("nodes", "edges"))
    return (nodes, edges) if repos is None else (nodes.where(F.col("repo").isin(repos)), edges.where(F.col("repo").isin(repos)))


def write_samples(samples: DataFrame, root: str) -> None:
    """Labelled samples as Parquet, a folder a repo."""
    samples.write.mode("overwrite").partitionBy("repo").parquet(root)


def read_samples(spark: SparkSession, root: str, first_repos: int | None = None, skip: int = 0) -> DataFrame:
    """Labelled samples, of all repos or of ``first_repos`` after the first ``skip`` by name."""
    rows = spark.read.parquet(root)
    if first_repos is None and not skip:
        return rows
    names = rows.select("repo").distinct().orderBy("repo").offset(skip)
    return rows.join(F.broadcast(names if first_repos is None else names.limit(first_repos)), "repo", "left_semi")


def write_split(rows: DataFrame, root: str) -> None:
    """Train and dev records as JSON, by column is_train."""
    for name, test in (("train", "is_train"), ("dev", "not is_train")):
        rows.where(test).drop("is_train").write.mode("overwrite").json(f"{root}/{name}")


def write_text_csv(rows: DataFrame, path: str) -> None:
    rows.select("text").write.mode("overwrite").option("header", "true").csv(path)


def merge_ranks(parts: list[DataFrame], key: str) -> DataFrame:
    """The rows of all ranks, ordered by key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(key)


def write_merged(parts: list[DataFrame], key: str, path: str, text: str | None = None) -> None:
    """The rows of all ranks in the order of ``key``: as lines of column ``text``, or as JSON."""
    rows = merge_ranks(parts, key)
    if text is None:
        rows.write.mode("overwrite").json(path)
    else:
        rows.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def log_metrics(spark: SparkSession, path: str, step: int, metrics: dict[str, float]) -> None:
    """Appends a row for each metric: step, name, value."""
    spark.createDataFrame([(step, k, float(v)) for k, v in sorted(metrics.items())], "step long, name string, value double").coalesce(1).write.mode("append").json(path)
