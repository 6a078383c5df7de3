"""The stand-in code graph: nodes, typed edges and seeds from the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, file_id, node_type (0 file, 1 function, 2 class), name, embedding, label."""
    i = F.col("vec_id")
    file_id, kind = F.floor(i / 10).cast("long"), (F.col("label") % 3).cast("int")
    stem = F.concat(F.lit("f"), file_id.cast("string"))
    cls = F.concat(stem, F.lit(".C"), (i % 7).cast("string"))
    name = F.when(kind == 0, F.concat(stem, F.lit(".py"))).when(kind == 2, cls).otherwise(F.concat(cls, F.lit(".m"), (i % 13).cast("string")))
    return table(spark, sf_dir, "embeddings").select(i.alias("idx"), file_id.alias("file_id"), kind.alias("node_type"), name.alias("name"), "embedding", "label")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, etype (0 import, 1 call, 2 file call, 3 file owns, 4 class owns), distinct."""
    n = table(spark, sf_dir, "embeddings").count()
    calls = table(spark, sf_dir, "lineitem").where("l_quantity >= 48 and l_discount >= 0.08").select((F.col("l_orderkey") % n).alias("src"), (F.col("l_partkey") % n).alias("dst"), (F.col("l_linenumber") % 5).cast("int").alias("etype")).where("src <> dst").distinct()
    v = nodes(spark, sf_dir).select("idx", "file_id", "node_type")
    files = v.where("node_type = 0").groupBy("file_id").agg(F.min("idx").alias("src"))
    own = v.where("node_type in (1, 2)").join(files, "file_id").select("src", F.col("idx").alias("dst"))
    typed = lambda d, t: d.withColumn("etype", F.lit(t))
    back = typed(calls.where("src % 10 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst")), 1)
    return calls.union(typed(own, 3)).union(typed(own.where("dst % 2 = 0"), 0)).union(back).distinct()


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("idx"))


#: The same in DuckDB SQL, as the head of an oracle.
PRELUDE = """
with recursive nodes as (select vec_id as idx, cast(floor(vec_id / 10) as bigint) as file_id, cast(label % 3 as int) as node_type,
  case label % 3 when 0 then concat('f', cast(floor(vec_id / 10) as bigint), '.py') when 2 then concat('f', cast(floor(vec_id / 10) as bigint), '.C', vec_id % 7)
    else concat('f', cast(floor(vec_id / 10) as bigint), '.C', vec_id % 7, '.m', vec_id % 13) end as name, cast(embedding as double[]) as v, label from embeddings),
call_base as (select distinct src, dst, etype from (select l_orderkey % (select count(*) from embeddings) as src, l_partkey % (select count(*) from embeddings) as dst,
  cast(l_linenumber % 5 as int) as etype from lineitem where l_quantity >= 48 and l_discount >= 0.08) t where src <> dst),
own_base as (select f.src, n.idx as dst from (select file_id, min(idx) as src from nodes where node_type = 0 group by file_id) f join nodes n on n.file_id = f.file_id and n.node_type in (1, 2)),
edges as (select src, dst, etype from call_base union select src, dst, 3 from own_base union select src, dst, 0 from own_base where dst % 2 = 0 union select dst, src, 1 from call_base where src % 10 = 0),
und as (select src as a, dst as b from edges union select dst, src from edges),
seeds as (select idx from nodes where idx % 50 = 0)
"""
