"""What the operators of this folder share: scratch tables, words, hashing, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

U64 = np.uint64
#: Multipliers of a 64-bit finaliser (odd constants; fixed values).
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
GOLDEN = 0x9E3779B97F4A7C15
#: A worker forgets its cached word hashes beyond this many words; results do not depend on it.
CACHE_WORDS = 200_000


class Scratch:
    """Parquet tables that cut lineage, under the folder of ``spark.checkpoint.dir``.

    Every executor and the driver can read them, so a lost executor costs a re-run of single tasks only.  Where
    the session names no folder, one temporary folder is made in local mode; elsewhere that is an error.  Tables
    are deleted by ``drop`` or when the JVM ends.  The package is sent to the executors on the way.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = f"file://{tempfile.mkdtemp(prefix='tesserae-')}"
            spark.sparkContext.setCheckpointDir(root)
        self.root = f"{root.rstrip('/')}/tesserae-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.root))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id, n: int = 5):
    """crc32 of the decimal doc_id, modulo ``n``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def words(text: bytes) -> list[bytes]:
    """Lower-case A-Z, then the runs of bytes that are not 0x20 or 0x09-0x0D."""
    return text.lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = (x ^ (x >> U64(30))) * MIX_A
    x = (x ^ (x >> U64(27))) * MIX_B
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column; None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def trim() -> None:
    """Give freed memory back to the system, so that reused workers do not keep what an earlier stage needed."""
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free is not None:
        free(0)
    pa.default_memory_pool().release_unused()


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most`` bytes; a longer text comes alone."""
    for b in batches:
        col = b.column(column)
        sizes = np.frombuffer(col.buffers()[1], np.int64 if "large" in str(col.type) else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
            yield b.slice(at, end - at)
            at = end
        trim()


def binary_rows(rows: np.ndarray) -> pa.Array:
    """A fixed-width 2-D array as a binary column, one value a row."""
    n, wide = rows.shape[0], rows.shape[1] * rows.itemsize
    data = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * wide, wide, dtype=np.int32)), pa.py_buffer(data)])


def lists(flat: np.ndarray, wide: int) -> pa.Array:
    """A flat array as a list column with ``wide`` elements a row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, wide, dtype=np.int32)), pa.array(flat))
