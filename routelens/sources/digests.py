"""SHA-256 of files of any size: large ones are read in splits, and a digest goes on from task to task."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import checkpoint_dir, settled

#: Bytes up to which a file is hashed in one row; bytes of a file that one task adds to its digest, about (a split and a line more at most).
WHOLE, LINK = 128 << 20, 128 << 20
#: Bytes of one piece, about.
PIECE = 1 << 20
#: Bytes of the library's structure of a begun digest (112), and some to spare.
_STATE = 256


class _Begun:
    """A begun SHA-256 by the library that hashlib uses; hashlib itself can't store one."""

    def __init__(self, state: bytes | None) -> None:
        import _hashlib

        self.library, self.state = ctypes.CDLL(_hashlib.__file__), ctypes.create_string_buffer(_STATE)
        if state is None:
            self.library.SHA256_Init(self.state)
        else:
            ctypes.memmove(self.state, state, _STATE)

    def add(self, data: bytes) -> None:
        self.library.SHA256_Update(self.state, ctypes.c_char_p(data), ctypes.c_size_t(len(data)))

    def hex(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.library.SHA256_Final(out, self.state)
        return out.raw.hex()


def file_digests(spark: SparkSession, paths: list[str], whole: int = WHOLE, link: int = LINK) -> DataFrame:
    """path, length and sha256 of files, or of the files in folders.

    A file up to ``whole`` bytes is one row. Larger ones are read as lines, in splits by many tasks, and stored as pieces;
    then one task after the other takes the next ``link`` bytes of each file and the digest that its predecessor has begun.
    """
    files = spark.read.format("binaryFile").load(paths)
    small = files.where(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select("path", "length", F.col("_metadata.file_path").alias("file"))
    names = [r.path for r in large.collect()]  # names only; Spark lists them on the driver anyway
    return small.unionByName(_chained(spark, large, names, link)) if names else small


def _chained(spark: SparkSession, files: DataFrame, names: list[str], link: int) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(names)
    pieces = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").cast("binary").alias("value")).mapInArrow(_pieces, "file string, begin long, at long, data binary")
    checkpoint_dir(spark.sparkContext)
    place = f"{spark.sparkContext.getCheckpointDir()}/pieces-{uuid.uuid4().hex}"
    pieces.withColumn("link", F.floor(F.col("begin") / link)).write.partitionBy("link").option("compression", "none").option("parquet.block.size", str(16 << 20)).parquet(place)
    stored = spark.read.parquet(place)
    state = settled(files.select("file", F.lit(-1).cast("long").alias("begin"), F.lit(-1).cast("long").alias("at"), F.lit(None).cast("binary").alias("data"), F.lit(0).cast("long").alias("done")))
    for number in sorted(r.link for r in stored.select("link").distinct().collect()):
        added = stored.where(F.col("link") == number).select("file", "begin", "at", "data", F.lit(None).cast("long").alias("done"))
        state = settled(state.unionByName(added).repartition("file").sortWithinPartitions("file", "begin", "at").mapInArrow(_continued, state.schema))
    ended = files.join(state.select("file", "data", "done"), "file")
    return ended.select("path", "length", "data", "done").mapInArrow(_ended, "path string, length long, sha256 string")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a split put together to pieces: ``at`` counts the bytes before a piece in its split, the mark behind each line included."""
    own, at, held, size = None, 0, [], 0

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([own[0]]), pa.array([own[1]], pa.int64()), pa.array([at], pa.int64()), pa.array([b"\n".join(held)], pa.binary())], ["file", "begin", "at", "data"])

    for batch in batches:
        for file, begin, value in zip(batch["file"].to_pylist(), batch["begin"].to_pylist(), batch["value"].to_pylist(), strict=True):
            if held and (size >= PIECE or own != (file, begin)):
                yield told()
                at, held, size = at + size, [], 0
            if own != (file, begin):
                own, at = (file, begin), 0
            held.append(value)
            size += len(value) + 1
    if held:
        yield told()


def _continued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each file's begun digest, which comes first, with its next pieces; a mark stands between two pieces."""
    own, digest, done = None, None, 0

    def told() -> pa.RecordBatch:
        columns = [pa.array([own]), *[pa.array([-1], pa.int64())] * 2, pa.array([digest.state.raw], pa.binary()), pa.array([done], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["file", "begin", "at", "data", "done"])

    for batch in batches:
        for file, begin, data, before in zip(batch["file"], batch["begin"], batch["data"], batch["done"], strict=True):
            file, data = file.as_py(), data.as_py()
            if begin.as_py() < 0:
                if own is not None:
                    yield told()
                own, digest, done = file, _Begun(data), before.as_py()
                continue
            if done:
                digest.add(b"\n")
            digest.add(data)
            done += len(data) + 1
    if own is not None:
        yield told()


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests ended; ``done`` counts a mark behind the last line, which the file may have or not."""
    for batch in batches:
        found = []
        for path, length, data, done in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if done - length not in (0, 1):  # lines that were read aren't the file: it has changed, or begins with a byte order mark
                raise ValueError(f"{path}: {length} bytes, but {done} were read as lines")
            digest = _Begun(data)
            if done == length:
                digest.add(b"\n")
            found.append(digest.hex())
        yield pa.RecordBatch.from_arrays([batch["path"], batch["length"], pa.array(found, pa.string())], ["path", "length", "sha256"])
