"""Shards of nearly equal bytes by Karmarkar-Karp differencing of indivisible groups.

Rows of equal text are a group and stay in one shard. The partial partitions with the largest
spread are combined again and again, the fullest parts of one with the emptiest of the other, until
one is left (``combined``). This runs on two levels:

* Groups are dealt to a fixed number of buckets by digest. A task streams its buckets' groups in
  descending size and differences blocks of them; each block joins its bucket's parts in opposite order.
* The buckets' parts, and the groups that hold more than a fixed share of the bytes or rows (at most
  ``2 * LARGE``, whatever the input), are combined on the driver. A group as large as a fair shard of what
  is left has a shard for itself: no partition without cutting it is more equal.

What passes through the driver is bounded by ``BUCKETS``, ``LARGE`` and the number of shards. Rows meet
their groups by a join in which no key has many rows, as the large groups are looked up in a table
of that bounded size that all tasks have.

Defined cases. A null text is an empty one, so they are one group. Repeated rows get slots of their
own. Fewer groups than shards leave shards empty. A null ``doc_id`` stands first in its shard. No rows: no rows. Other columns
are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import keep, mapped, parts, table

SHARDS = 24
#: Bytes a row counts beside its text.
ROW_BYTES = 8
#: Buckets of small groups; groups with a larger share than 1 / LARGE of all bytes or rows are no small ones; groups differenced at a time.
BUCKETS, LARGE, BLOCK = 1024, 16_384, 8_192


def combined(partials: list[tuple[list[int], list[list]]], shards: int) -> tuple[list[int], list[list]]:
    """One partition of all: sums in descending order, and the members of each part.

    ``partials`` have descending sums and members for each; theirs are used up.
    """
    heap = [(sums[-1] - sums[0], i, sums, members) for i, (sums, members) in enumerate(partials)]
    heapq.heapify(heap)
    if not heap:
        return [0] * shards, [[] for _ in range(shards)]
    while len(heap) > 1:
        _, i, sums, members = heapq.heappop(heap)
        _, _, other, others = heap[0]
        sums, members = joined(sums, members, other, others)
        heapq.heapreplace(heap, (sums[-1] - sums[0], i, sums, members))
    return heap[0][2], heap[0][3]


def joined(sums: list[int], members: list[list], other: list[int], others: list[list]) -> tuple[list[int], list[list]]:
    """Two partial partitions added in opposite order."""
    added = []
    for a, m, b, n in zip(sums, members, reversed(other), reversed(others), strict=True):
        if len(m) < len(n):
            m, n = n, m
        m.extend(n)
        added.append((a + b, m))
    added.sort(key=lambda x: -x[0])
    return [a for a, _ in added], [m for _, m in added]


def single(size: int, name, shards: int) -> tuple[list[int], list[list]]:
    """The partial partition of one group."""
    return [size, *[0] * (shards - 1)], [[name], *[[] for _ in range(shards - 1)]]


def divided(items: list[tuple], shards: int) -> dict:
    """The part of each of ``items`` (name, size): what is as large as a fair part of the rest has a part for itself."""
    items = sorted(items, key=lambda x: (-x[1], x[0]))
    left, alone = sum(size for _, size in items), 0
    while alone < min(shards - 1, len(items)) and items[alone][1] * (shards - alone) >= left:
        left -= items[alone][1]
        alone += 1
    rest = shards - alone
    _, members = combined([single(size, name, rest) for name, size in items[alone:]], rest)
    return {name: j for j, (name, _) in enumerate(items[:alone])} | {name: alone + j for j, m in enumerate(members) for name in m}


def described(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, digest of every row; the text isn't needed any more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))


def _differenced(shards: int):
    """Groups of buckets, in order, to (bucket, digest, part, sum): parts by descending sum, the sum told once at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sums, place, block = None, [], [], []

        def flushed() -> pa.RecordBatch:
            """The block joins its bucket's parts: its fullest part goes to the emptiest of theirs."""
            nonlocal sums
            own, members = combined([single(size, digest, shards) for digest, size in block], shards)
            order = sorted(range(shards), key=lambda j: sums[j])  # parts of the bucket keep their names
            told = [(here, digest, j, None) for j, m in zip(order, members, strict=True) for digest in m]
            for j, a in zip(order, own, strict=True):
                sums[j] += a
            block.clear()
            return _rows(told)

        for batch in batches:
            for bucket, digest, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != here:
                    if here is not None:
                        yield flushed()
                        yield _rows([(here, None, j, a) for j, a in enumerate(sums)])
                    here, sums = bucket, [0] * shards
                block.append((digest, size))
                if len(block) == BLOCK:
                    yield flushed()
        if here is not None:
            yield flushed()
            yield _rows([(here, None, j, a) for j, a in enumerate(sums)])

    return run


def _rows(told: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*told, strict=True)) if told else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.int64()), strict=True)], names=["bucket", "digest", "part", "sum"])


def assigned(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (with size and digest) and the shard of their group."""
    spark = rows.sparkSession
    groups = keep(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "groups")
    all_bytes, all_rows = groups.agg(F.sum("bytes"), F.sum("rows")).first()
    if all_rows is None:
        return rows.withColumn("shard", F.lit(0))
    # exact: at most LARGE groups by either share
    large = (F.col("bytes") > F.lit(all_bytes) / LARGE) | (F.col("rows") > F.lit(all_rows) / LARGE)
    few = [(bytes(r.digest), r.bytes) for r in groups.where(large).select("digest", "bytes").collect()]
    small = groups.where(~large).select(F.pmod(F.xxhash64("digest"), F.lit(BUCKETS)).alias("bucket"), "digest", "bytes")
    dealt = small.repartition(parts(spark), "bucket").sortWithinPartitions("bucket", F.col("bytes").desc(), "digest")
    told = keep(mapped(dealt, _differenced(shards), "bucket long, digest binary, part int, sum long"), "parts")
    lumps = [((r.bucket, r.part), r.sum) for r in told.where("digest is null").select("bucket", "part", "sum").collect()]  # BUCKETS * shards at most
    shard_of = divided([((-1, digest), size) for digest, size in few] + lumps, shards)

    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType())])
    of_part = spark.createDataFrame([(*name, shard_of[name]) for name, _ in lumps], schema)
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("large", T.IntegerType())])
    of_group = spark.createDataFrame([(digest, shard_of[-1, digest]) for digest, _ in few], schema)
    small_groups = told.where("digest is not null").join(F.broadcast(of_part), ["bucket", "part"]).select("digest", "shard")
    known = rows.join(F.broadcast(of_group), "digest", "left")
    both = known.where("large is null").drop("large").join(small_groups.hint("merge"), "digest")
    return both.unionByName(known.where("large is not null").withColumnRenamed("large", "shard"))


def slotted(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, digest, shard and more) with slots from 0 on in each shard, by doc_id.

    Rows are range-partitioned; the slots before a partition's rows of a shard come from counts, one row for each such pair.
    """
    spark = rows.sparkSession
    order = ["shard", "doc_id", "digest"]
    dealt = rows.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    dealt = keep(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "slots")
    counts = dealt.groupBy("shard", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    begins = counts.select(F.col("shard").alias("_shard"), F.col("_part").alias("_p"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    told = dealt.join(F.broadcast(begins), (dealt.shard == begins._shard) & (dealt._part == begins._p))  # partitions + shards rows at most
    return told.withColumn("slot", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shard", "_p", "_shift")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    rows = keep(described(docs), "described")
    return slotted(assigned(rows, shards)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 24 shards of nearly equal bytes."""
    return shard(table(spark, sf_dir, "documents"))
