"""Corpus pipeline over ``documents``: language ID, near-duplicate removal, source mixing, packing.

Cases, for every stage: nulls in any column, empty and very long texts, repeated rows and tables without rows are
taken, as the operators' docstrings say; columns of any name come through the first three stages unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.common import Scratch
from tesserae.llm.language_id import identified_only
from tesserae.llm.mixing import mix
from tesserae.llm.near_dedup import without_near_duplicates
from tesserae.llm.packing import pack
from tesserae.shipping import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null and empty ones too) and texts in which no language has three tenths of the letters."""
    ship(spark)
    return identified_only(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: sets of five words, at 0.8 or more.

    Rows without a doc_id or without words stay; of rows alike in doc_id and words one stays.
    """
    ship(spark)
    return without_near_duplicates(docs, shingle=5)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, with sources flattened until the most repeated one is seen 1.25 times; null sources are one."""
    ship(spark)
    return mix(docs, repetition=1.25)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their bins; repeats of a document are one cluster and never share a bin; an empty text is its end token."""
    ship(spark)
    return pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("source_mix", source_mix), ("packing", packing)]
#: SQL cannot express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared scratch folder and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, name)
    return docs
