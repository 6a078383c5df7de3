"""From the sources of a repository and its call graph to nodes and typed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import resolve as J
from ..operators.numbering import numbered
from ..scratch import materialised
from ..sources import code as P


def repo_graph(files: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, misses) of ``files`` (path, text) and ``calls`` (place, node, called: what the node calls).

    nodes: idx, path, kind, name, body; within the order of the paths a file's functions, its classes, each before
    its methods, and the file.  edges: src, dst, etype, distinct: 0 imports, 1 calls of functions, classes and
    methods, 2 calls of files, 3 a file owns, 4 a class owns.  misses: by path, how many of its functions, classes
    and methods the call graph has and lacks.  The first name or node that fits is the one of the lowest number.
    Files that do not parse have their own node only; null texts have none.
    """
    found = materialised(P.parse(files))
    own = P.file_rows(files).select("path", F.lit("file").alias("kind"), "name", F.lit(None).cast("string").alias("owner"), "body", F.lit(1 << 30).alias("ord"))
    rank = F.when(F.col("kind") == "function", 0).when(F.col("kind").isin("class", "method"), 1).otherwise(2)
    every = found.where("kind <> 'import'").select("path", "kind", "name", "owner", "body", "ord").unionByName(own).withColumn("rank", rank)
    nodes = materialised(numbered(every, "path", "rank", "ord", name="idx"))
    names = nodes.select("idx", F.xxhash64("path").alias("file_id"), "name")
    graph = numbered(calls.select("place", F.col("node").alias("name")), "place", name="idx").select("idx", "name")
    callers = materialised(J.callers(names, graph))
    called = calls.join(graph.withColumnRenamed("name", "node"), "node").select(F.col("idx").alias("caller"), F.explode("called").alias("node"))
    edges = J.call_edges(callers, names, called)
    owned = nodes.where("owner is not null").select("path", F.col("owner").alias("name"), F.col("idx").alias("dst"))
    owners = nodes.where("kind in ('file', 'class')").groupBy("path", "name").agg(F.min("idx").alias("src"), F.max((F.col("kind") == "class").cast("int")).alias("cls"))
    edges = edges.unionByName(owned.join(owners, ["path", "name"]).select("src", "dst", (F.col("cls") + 3).alias("etype")))
    file_of = nodes.where("kind = 'file'").select("path", F.col("idx").alias("src"))
    imports = found.where("kind = 'import'").select("path", F.col("name").alias("imp")).join(file_of, "path").select("src", "imp")
    edges = edges.unionByName(J.import_edges(imports, names.select("idx", "name")))
    misses = J.call_misses(callers).join(nodes.select("path").distinct().withColumn("file_id", F.xxhash64("path")), "file_id").select("path", "captured", "missed")
    return nodes.select("idx", "path", "kind", "name", "body"), edges.distinct(), misses
