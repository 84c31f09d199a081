"""Shared helpers: reading tables, shared-folder tables, bounded sub-batches, hashing."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Text bytes that a Python worker expands into numpy arrays at a time.
SLICE_BYTES = 1 << 19


#: Rows of an Arrow batch, where the session leaves Spark's default: whole texts are long rows.
BATCH_ROWS, DEFAULT_ROWS = 1024, "10000"


def release() -> None:
    """Give freed memory back: a worker is used again, and what it keeps counts against its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in small batches, with memory given back after each partition."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == DEFAULT_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session may leave it unset: it then gets one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), f"routelens-{os.getuid()}")
        os.makedirs(found, exist_ok=True)
    return found


#: Folders written by ``keep`` in this process, oldest first.
_KEPT: list[str] = []


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/routelens/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(path)
    _KEPT.append(path)
    return spark.read.schema(df.schema).parquet(path)


def kept() -> int:
    """How many tables ``keep`` has written so far that are still there: a mark for ``forget``."""
    return len(_KEPT)


def forget(spark: SparkSession, since: int, but: int = 0) -> None:
    """Delete the tables kept after the mark, except the last ``but``; no DataFrame that reads them may be used again."""
    end = len(_KEPT) - but
    for path in _KEPT[since:end]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _KEPT[since:end]


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when the input files make fewer partitions than there are cores."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def parts(spark: SparkSession) -> int:
    """Shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(sizes, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes sum to ``limit`` at most; a larger row stands alone."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if len(sizes) > begin:
        yield begin, len(sizes)


def texts_of(column: pa.Array) -> list[str]:
    """Strings of a column; null counts as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up), 1 << 12)
            with np.errstate(over="ignore"):
                for name, base in (("up", _BASE), ("down", _INVERSE)):
                    x = np.full(m, base, U64)
                    x[0] = 1
                    setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_hash(units: np.ndarray) -> np.ndarray:
    """H with H[i] = sum of mixed units[j] * base**j, j < i; substrings hash by ``span_hash``."""
    with np.errstate(over="ignore"):
        up, _ = POWERS.upto(len(units) + 1)
        out = np.zeros(len(units) + 1, U64)
        values = _UNIT[units] if units.dtype == np.uint8 else mix(units.astype(U64) + U64(0x51ED270B))
        np.cumsum(values * up[: len(units)], out=out[1:])
    return out


with np.errstate(over="ignore"):
    _UNIT = mix(np.arange(256, dtype=U64) + U64(0x51ED270B))


def span_hash(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of units[begin:end]; equal strings have equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        _, down = POWERS.upto(len(h))
        return mix((h[end] - h[begin]) * down[begin] + (end - begin).astype(U64) * U64(0xD6E8FEB86659FD93))
