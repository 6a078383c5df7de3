"""Source trees: reading files, and parsing Python text into functions, classes, methods and imports."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITIES = "path string, kind string, name string, owner string, body string, ord int"
#: The file patterns of the multi-language scan (the last has no dot).
PATTERNS = ["*.java", "*.c", "*.cpp", "*.cc", "*.cuda", "*.js", "*.go", "*.py", "*jsx"]


def read_sources(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """(path, text) of the files under ``root`` whose names match; any store that Spark reads."""
    glob = "{" + ",".join(patterns or ["*.py"]) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return raw.select("path", F.decode("content", "UTF-8").alias("text"))


def namespace(path: str) -> str:
    """Base name up to its first dot; ``parent.__init__`` for package files."""
    parts = path.replace("\\", "/").split("/")
    stem = parts[-1].split(".")[0]
    return f"{parts[-2]}.{stem}" if stem == "__init__" and len(parts) > 1 else stem


def entities_of(path: str, text: str) -> list[tuple]:
    """Rows (path, kind, name, owner, body, ord): functions, classes, methods and from-imports of one file."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    ns, out = namespace(path), []
    taken: set[int] = set()

    def add(kind: str, name: str, owner: str | None, node: ast.AST | None) -> None:
        out.append((path, kind, name, owner, ast.get_source_segment(text, node) if node is not None else None, len(out)))

    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            name = f"{ns}.{node.name}"
            add("class", name, f"{ns}.py", node)
            for m in ast.walk(node):
                taken.add(id(m))
                if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef):
                    add("method", f"{name}.{m.name}", name, m)
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            if id(node) not in taken:
                add("function", f"{ns}.{node.name}", f"{ns}.py", node)
            taken.update(id(m) for m in ast.walk(node))
    for node in ast.walk(tree):
        if isinstance(node, ast.ImportFrom) and id(node) not in taken:
            for alias in node.names:
                add("import", f"{node.module}.{alias.name}", f"{ns}.py", None)
    return out


def parse(files: DataFrame) -> DataFrame:
    """The entities of (path, text) rows; broken sources give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, t in zip(b.path, b.text, strict=True) if t is not None for r in entities_of(p, t)]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "owner", "body", "ord"])

    return files.select("path", "text").mapInPandas(run, ENTITIES)


FILES = "path string, name string, body string, names array<string>, types array<int>"


def remainder_of(path: str, text: str) -> tuple:
    """(path, name, body, names, types) of a file's own node: its text without classes and functions, what it owns (type 3)."""
    found, body = entities_of(path, text), text
    for kind in ("class", "function"):
        for e in found:
            if e[1] == kind and e[4]:
                body = body.replace(e[4], "")
                body = body.strip() if kind == "function" else body
    own = [e[2] for kind in ("function", "class") for e in found if e[1] == kind]
    return path, f"{namespace(path)}.py", body, own, [3] * len(own)


def file_rows(files: DataFrame) -> DataFrame:
    """A row for each file (path, text) with text: its own node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([remainder_of(p, t) for p, t in zip(b.path, b.text, strict=True) if t is not None], columns=["path", "name", "body", "names", "types"])

    return files.select("path", "text").mapInPandas(run, FILES)


def compiles(files: DataFrame) -> DataFrame:
    """The rows of (path, text) that are valid Python."""

    def fine(text: str | None) -> bool:
        try:
            ast.parse(text or "")
        except (SyntaxError, ValueError):
            return False
        return text is not None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[fine(t) for t in b.text]]

    return files.mapInPandas(run, files.schema)


def head_name(code):
    """Name of the function or class that the text starts with; null otherwise."""
    return F.nullif(F.regexp_extract(code, r"^(def|class)\s+([A-Za-z_]\w*)", 2), F.lit(""))
