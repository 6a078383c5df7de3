"""Dense row numbers in an order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialised


def numbered(rows: DataFrame, *order, name: str = "nr") -> DataFrame:
    """``rows`` with their places from 0 by ``order``; rows that tie stand in the order of their other columns.

    Rows are sorted over ranges; a row's place is its place in its partition plus the rows of the partitions before,
    of which the driver holds one number a partition.
    """
    ties = [c for c, kind in rows.dtypes if not kind.startswith("map")]
    held = materialised(rows.orderBy(*order, *ties).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    before, starts = 0, []
    for r in held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        starts += [F.lit(r.p), F.lit(before)]
        before += r.n
    if not starts:
        return held.select(*rows.columns, F.lit(0).cast("long").alias(name))
    inside = F.col("_at").bitwiseAND((1 << 33) - 1)
    return held.select(*rows.columns, (inside + F.create_map(*starts)[part].cast("long")).alias(name))


def starts(sizes: DataFrame, key: str, size: str, name: str = "start") -> DataFrame:
    """``sizes`` with the sum of ``size`` over the rows before, by ``key``: running sums inside ranges, and one sum a range on the driver."""
    held = materialised(sizes.orderBy(key).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftrightunsigned("_at", 33)))
    before, offsets = 0, []
    for r in held.groupBy("_part").agg(F.sum(size).alias("n")).orderBy("_part").collect():
        offsets += [F.lit(r._part), F.lit(before)]
        before += r.n
    if not offsets:
        return held.select(*sizes.columns, F.lit(0).cast("long").alias(name))
    inside = F.sum(size).over(Window.partitionBy("_part").orderBy("_at")) - F.col(size)
    return held.select(*sizes.columns, (inside + F.create_map(*offsets)[F.col("_part")].cast("long")).alias(name))
