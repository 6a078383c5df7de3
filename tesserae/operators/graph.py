"""Graph construction: keys, edge lists, relations, the query node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered, starts

#: Fixed values: (source type, relation, target type, edge type) with node types 0 code, 1 functions, 2 classes.
RELATIONS = [
    ("classes", "owns", "functions", 4), ("code", "owns", "functions", 3), ("code", "owns", "classes", 3), ("functions", "call", "functions", 1), ("classes", "call", "functions", 1),
    ("classes", "call", "classes", 1), ("code", "import", "functions", 0), ("code", "import", "classes", 0), ("code", "call", "functions", 2), ("code", "call", "classes", 2),
]
TYPE_NAMES = {0: "code", 1: "functions", 2: "classes"}


def surrogate_keys(nodes: DataFrame) -> DataFrame:
    """(idx, key): dense from 0 within each file's own order (functions, classes, the file), files first.

    A file's offset is a running sum over one row a file, itself summed range by range.
    """
    kind = F.when(F.col("node_type") == 1, 0).when(F.col("node_type") == 2, 1).otherwise(2)
    inner = nodes.withColumn("k", F.row_number().over(Window.partitionBy("file_id").orderBy(kind, "idx")).cast("long") - 1)
    size = nodes.groupBy("file_id").agg(F.count("*").alias("n"))
    start = starts(size, "file_id", "n").select("file_id", "start")
    return inner.join(start, "file_id").select("idx", (F.col("start") + F.col("k")).alias("key"))


def edge_lists(edges: DataFrame) -> DataFrame:
    """(etype, src, targets): the sorted targets of each source by type."""
    return edges.groupBy("etype", "src").agg(F.sort_array(F.collect_list("dst")).alias("targets"))


def last_edge_wins(edges: DataFrame) -> DataFrame:
    """(src, dst, etype): of each source the edge that comes last by (etype, dst)."""
    last = edges.groupBy("src").agg(F.max(F.struct("etype", "dst")).alias("m"))
    return last.select("src", "m.dst", "m.etype")


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def typed_relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src_type, rel, dst_type, src, dst) for the ten relations; other combinations are dropped."""
    rows = nodes.sparkSession.createDataFrame(RELATIONS, "src_type string, rel string, dst_type string, etype int")
    name = F.create_map(*[x for k, v in TYPE_NAMES.items() for x in (F.lit(k), F.lit(v))])
    kind = nodes.select("idx", name[F.col("node_type")].alias("kind"))
    both = edges.join(kind.select(F.col("idx").alias("src"), F.col("kind").alias("src_type")), "src").join(kind.select(F.col("idx").alias("dst"), F.col("kind").alias("dst_type")), "dst")
    return both.join(F.broadcast(rows), ["src_type", "dst_type", "etype"]).select("src_type", "rel", "dst_type", "src", "dst")


def type_positions(nodes: DataFrame) -> DataFrame:
    """(idx, node_type, pos): position from 0 among the nodes of the same type in the same file, by idx."""
    w = Window.partitionBy("file_id", "node_type").orderBy("idx")
    return nodes.select("idx", "node_type", (F.row_number().over(w) - 1).cast("long").alias("pos"))


def with_query_node(members: DataFrame, inside: DataFrame, current: DataFrame, called: DataFrame) -> DataFrame:
    """Edges (sg, src, dst, etype) of renumbered subgraphs plus the query node m = number of members.

    ``current`` (sg, idx) is the file of the query: edge type 3 to m; ``called`` (sg, idx): edges type 1 from m.
    """
    m = members.groupBy("sg").agg(F.count("*").alias("m"))
    own = current.join(m, "sg").select("sg", F.col("idx").alias("src"), F.col("m").alias("dst"), F.lit(3).alias("etype"))
    call = called.join(m, "sg").select("sg", F.col("m").alias("src"), F.col("idx").alias("dst"), F.lit(1).alias("etype"))
    return inside.unionByName(own).unionByName(call)


def homogenised(parts: DataFrame) -> DataFrame:
    """(kind, pos, idx): nodes given by kind and place in it, concatenated in the order of their kinds."""
    return numbered(parts.select("kind", "pos"), "kind", "pos", name="idx")
