"""Running sums and ranks over an order that no single task holds."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def checkpoint_dir(context) -> None:
    """Sets the folder for checkpoints. Only a local session may leave it unset: it then gets one of its own."""
    if context.getCheckpointDir() is None:
        found = SparkSession.getActiveSession().conf.get("spark.checkpoint.dir", None)
        if not found:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = os.path.join(tempfile.gettempdir(), f"routelens-{os.getuid()}")
            os.makedirs(found, exist_ok=True)
        context.setCheckpointDir(found)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: lineage cut, and the same rows in the same partitions from now on."""
    checkpoint_dir(df.sparkSession.sparkContext)
    return df.checkpoint()


def tasks(df: DataFrame) -> int:
    """As many tasks as shuffles make. Asked for, they stay so many where few bytes are much work."""
    return max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to as many partitions as shuffles make: the input's files may make but one."""
    return df.repartition(tasks(df))


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``rows`` with the sums up to and with each row, in ascending order.

    Rows are range-partitioned once. A partition sums its own rows; one row for each
    partition, so as many as there are shuffle partitions, tells where its sums begin.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = rows.withColumns(dict(zip(keys, order, strict=True)) | {f"_s{i}": c for i, c in enumerate(sums.values())})
    own = settled(own.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()))
    totals = own.groupBy("_part").agg(*[F.sum(f"_s{i}").alias(f"_t{i}") for i in range(len(sums))])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    begins = totals.select("_part", *[(F.coalesce(F.sum(f"_t{i}").over(before), F.col(f"_t{i}") * 0)).alias(f"_b{i}") for i in range(len(sums))])
    here = W.partitionBy("_part").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    out = own.join(F.broadcast(begins), "_part").withColumns({name: F.sum(f"_s{i}").over(here) + F.col(f"_b{i}") for i, name in enumerate(sums)})
    return out.select(*rows.columns, *sums)


def scan(rows: DataFrame, by: list[str], order: list[Column], **outs: tuple[str, Column]) -> DataFrame:
    """``rows`` with values that gather over the rows of equal ``by`` in order, however many rows one key has.

    Kinds: sum (up to and with the row), last (the last that isn't null, the row's own included), lag and lead (of the
    neighbouring row; null beyond the ends). Rows are range-partitioned by key and order; a key that goes on in another
    partition is the first or the last of each, so two rows a partition carry what is needed from one to the next.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = rows.withColumns(dict(zip(keys, order, strict=True)) | {name: F.struct(c.alias("v")) if kind in ("lag", "lead") else c for name, (kind, c) in outs.items()})
    own = settled(own.repartitionByRange(n, *by, *keys).withColumn("_part", F.spark_partition_id()))
    key, place = F.struct(*by), F.struct(*keys)
    ends = own.groupBy("_part").agg(F.min(key).alias("_a"), F.max(key).alias("_z"))
    total = {
        "sum": lambda c: F.sum(c),
        "last": lambda c: F.max_by(c, F.when(c.isNotNull(), place)),
        "lag": lambda c: F.max_by(c, place),
        "lead": lambda c: F.min_by(c, place),
    }
    parts = own.join(F.broadcast(ends), "_part").where(key.eqNullSafe(F.col("_a")) | key.eqNullSafe(F.col("_z"))).groupBy("_part", *by).agg(*[total[kind](F.col(name)).alias(f"_t_{name}") for name, (kind, _) in outs.items()])
    line = W.partitionBy(*by).orderBy("_part")
    before, after = line.rowsBetween(W.unboundedPreceding, -1), line.rowsBetween(1, W.unboundedFollowing)
    carry = {"sum": lambda c: F.sum(c).over(before), "last": lambda c: F.last(c, True).over(before), "lag": lambda c: F.last(c, True).over(before), "lead": lambda c: F.first(c, True).over(after)}
    carried = parts.select(F.col("_part").alias("_p"), *[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], *[carry[kind](F.col(f"_t_{name}")).alias(f"_c_{name}") for name, (kind, _) in outs.items()])
    same = F.col("_part") == F.col("_p")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    here = W.partitionBy("_part", *by).orderBy(*keys)
    upto = here.rowsBetween(W.unboundedPreceding, 0)
    gathered = {  # lead by its own function: a frame up to the end is read again for each row
        "sum": lambda c, more: F.when(more.isNull(), F.sum(c).over(upto)).otherwise(F.coalesce(F.sum(c).over(upto), F.lit(0)) + more),
        "last": lambda c, more: F.coalesce(F.last(c, True).over(upto), more),
        "lag": lambda c, more: F.coalesce(F.lag(c).over(here), more)["v"],
        "lead": lambda c, more: F.coalesce(F.lead(c).over(here), more)["v"],
    }
    told = own.join(F.broadcast(carried), same, "left").withColumns({name: gathered[kind](F.col(name), F.col(f"_c_{name}")) for name, (kind, _) in outs.items()})
    return told.select(*rows.columns, *outs)


def quantiles(rows: DataFrame, by: str, value: str, **at: tuple[str, float]) -> DataFrame:
    """Exact quantiles of each group: ("linear", q) between neighbours, ("nearest", q) at the rank rounded half to even.

    Ranks come from the counts of distinct values, so a group of any size is spread out.
    """
    levels = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(levels, [F.col(by), F.col(value)], _upto=F.col("_n"))
    sizes = ranked.groupBy(by).agg((F.min(F.col("_upto") - F.col("_n"))).alias("_base"), F.sum("_n").alias("_all"))
    own = ranked.join(sizes, by).withColumns({"_hi": F.col("_upto") - F.col("_base") - 1, "_lo": F.col("_upto") - F.col("_base") - F.col("_n")})
    out = []
    for name, (kind, q) in at.items():
        place = F.lit(q) * (F.col("_all") - 1)
        pick = lambda k: F.max(F.when((F.col("_lo") <= k) & (k <= F.col("_hi")), F.col(value)))
        if kind == "nearest":
            out.append(pick(F.least(F.col("_all") - 1, F.bround(place, 0))).alias(name))
        else:
            low, high = pick(F.floor(place)), pick(F.ceil(place))
            out.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return own.groupBy(by).agg(*out)
