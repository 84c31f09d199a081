"""The usage log as a stream: running summaries, windowed counts, claims made once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.usage import usage_summary


def read_log(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """JSON lines as they arrive; lines that don't parse are kept apart in ``_corrupt_record``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("mode", "PERMISSIVE").json(folder)


def running_summary(log: DataFrame) -> DataFrame:
    """The usage summary of each run so far: as many rows of state as there are runs."""
    return usage_summary(log, "run_id")


def windowed_usage(log: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Tasks and billable tokens of each run in event-time windows; state goes once rows can't be late any more."""
    return log.withWatermark("event_ts", late).groupBy(F.window("event_ts", width).alias("w"), "run_id").agg(F.count(F.lit(1)).alias("tasks"), F.sum("billable_tokens").alias("billable"))


def claimed_once(occurrences: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (job, due) once, within the watermark."""
    return occurrences.withWatermark("due", late).dropDuplicatesWithinWatermark(["job_id", "due"])


def to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """A query into a table in memory that handles what is there and ends."""
    return stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
