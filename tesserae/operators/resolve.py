"""Name resolution joins; "first" is always the lowest position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_segment(name: Column, sep: str = ".") -> Column:
    return F.substring_index(name, sep, -1)


def _parts(rows: DataFrame, text: str, names: DataFrame, name: str = "name") -> DataFrame:
    """``rows`` with column ``name``: each different part of ``text`` that is as long as some of ``names``.

    A test whether a text contains a name becomes an equality; the driver holds the different lengths of names only.
    """
    lengths = sorted(r[0] for r in names.select(F.length(name)).distinct().collect() if r[0])
    if not lengths:
        return rows.limit(0).withColumn(name, F.lit(None).cast("string"))
    long = F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(text)))
    one = rows.withColumn("_n", long)
    return one.withColumn(name, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - F.col("_n") + 1), lambda i: F.substring(F.col(text), i, F.col("_n")))))).drop("_n")


def contains_first(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, idx): the first node whose name contains ``name``, one row a name that has one."""
    wanted = names.select("name").distinct()
    parts = _parts(nodes.groupBy(F.col("name").alias("node")).agg(F.min("idx").alias("idx")), "node", wanted)
    return parts.join(wanted, "name").groupBy("name").agg(F.min("idx").alias("idx"))


def suffix_first(node_names: DataFrame, names: DataFrame) -> DataFrame:
    """(node, idx): the first of ``names`` (idx, name) that ``node`` ends with.

    Every suffix of a node is exploded, so the character-level test becomes a hash join.
    """
    ends = node_names.select("node").distinct().withColumn("name", F.explode(F.transform(F.sequence(F.lit(1), F.length("node")), lambda i: F.substring(F.col("node"), i, F.length("node")))))
    return ends.join(names, "name").groupBy("node").agg(F.min("idx").alias("idx"))


def resolve_imports(imports: DataFrame, names: DataFrame) -> DataFrame:
    """(imp, idx): first name that the import contains; only without one, the first with the same last segment
    that does not end in ``.py``."""
    one = imports.select("imp").distinct()
    inside = _parts(one, "imp", names).join(names, "name").select("imp", F.lit(0).alias("pass"), "idx")
    seg = names.where(~F.col("name").endswith(".py")).select("idx", last_segment(F.col("name")).alias("seg"))
    last = one.withColumn("seg", last_segment(F.col("imp"))).join(seg, "seg").select("imp", F.lit(1).alias("pass"), "idx")
    best = inside.unionByName(last).groupBy("imp").agg(F.min(F.struct("pass", "idx")).alias("m"))
    return best.select("imp", "m.idx")


def file_nodes(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, idx): nodes without a dot beyond their suffix whose stem is the file's."""
    stem = F.regexp_replace("name", r"\.py$", "")
    undotted = nodes.select("idx", stem.alias("file")).where(~F.col("file").contains("."))
    return files.select("file").distinct().join(undotted, "file")


def last_wins(nodes: DataFrame) -> DataFrame:
    """(name, idx): the inverse of idx -> name, in which the last duplicate wins."""
    return nodes.groupBy("name").agg(F.max("idx").alias("idx"))


def gold_matches(golds: DataFrame, nodes: DataFrame) -> DataFrame:
    """(gold, idx): nodes one of whose dotted segments is the gold name; segments are exploded into a hash join."""
    seg = nodes.select("idx", F.explode(F.array_distinct(F.split("name", r"\."))).alias("gold"))
    return golds.select("gold").distinct().join(seg, "gold")


def call_weights(code: DataFrame, imports: DataFrame) -> DataFrame:
    """(sample, idx, weight): share of the non-overlapping occurrences of each import's last segment in the code."""
    seg = imports.select("sample", "idx", last_segment(F.col("name")).alias("seg")).where("seg <> ''")
    n = (F.length("code") - F.length(F.replace("code", F.col("seg")))) / F.length("seg")
    found = code.join(seg, "sample").withColumn("n", n).where("n > 0")
    total = found.groupBy("sample").agg(F.sum("n").alias("total"))
    return found.join(total, "sample").select("sample", "idx", (F.col("n") / F.col("total")).alias("weight"))


def expand_class(some: DataFrame, nodes: DataFrame) -> DataFrame:
    """(idx, other): nodes of the same file whose last segment occurs in the node's full name, and the node."""
    a = some.join(nodes.select("idx", "file_id", "name"), "idx")
    b = nodes.select("file_id", F.col("idx").alias("other"), last_segment(F.col("name")).alias("seg"))
    return a.join(b, "file_id").where("contains(name, seg) or idx = other").select("idx", "other").distinct()


def fallback_edges(bodies: DataFrame, imports: DataFrame, names: DataFrame, existing: DataFrame) -> DataFrame:
    """(src, dst): bodies of a file that mention the last segment of one of its imports, resolved, and new."""
    mention = bodies.join(imports, "file").where(F.contains(F.col("body"), last_segment(F.col("imp")))).select("src", "imp")
    return mention.join(resolve_imports(imports, names), "imp").select("src", F.col("idx").alias("dst")).distinct().join(existing, ["src", "dst"], "left_anti")


def callers(names: DataFrame, graph: DataFrame) -> DataFrame:
    """(idx, file_id, etype, caller): each of ``names`` (idx, file_id, name) with its node of the call graph (idx, name).

    A file's is the undotted node that is its stem (etype 2); others' the first that contains their name (etype 1).
    The caller is null where there is none.
    """
    is_file = F.col("name").endswith(".py")
    first = contains_first(names.where(~is_file), graph).withColumnRenamed("idx", "caller")
    some = names.where(~is_file).join(first, "name", "left").select("idx", "file_id", F.lit(1).alias("etype"), "caller")
    plain = graph.where(~F.col("name").contains(".")).groupBy(F.col("name").alias("stem")).agg(F.min("idx").alias("caller"))
    files = names.where(is_file).withColumn("stem", F.substring_index("name", ".", 1)).join(plain, "stem", "left")
    return some.unionByName(files.select("idx", "file_id", F.lit(2).alias("etype"), "caller"))


def call_edges(found: DataFrame, names: DataFrame, calls: DataFrame) -> DataFrame:
    """(src, dst, etype): ``found`` callers to the first name that ends what they call; ``calls`` has caller and node."""
    ends = suffix_first(calls, names.select("idx", "name")).withColumnRenamed("idx", "dst")
    return found.join(calls, "caller").join(ends, "node").select(F.col("idx").alias("src"), "dst", "etype").distinct()


def import_edges(imports: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst, etype 0): the file ``src`` of an import (src, imp) to the name that the import resolves to."""
    return imports.join(resolve_imports(imports, names), "imp").select("src", F.col("idx").alias("dst"), F.lit(0).alias("etype")).distinct()


def call_misses(found: DataFrame) -> DataFrame:
    """(file_id, captured, missed): functions, classes and methods of a file with and without a node; files do not count."""
    one = found.where("etype = 1")
    return one.groupBy("file_id").agg(F.count("caller").alias("captured"), F.count_if(F.col("caller").isNull()).alias("missed"))
