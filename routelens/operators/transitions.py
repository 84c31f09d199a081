"""Histories whose every verdict depends on the ones before: states of runs, and saves that must know the current version."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .running import scan, settled

#: Which states may follow each; a run begins queued, and one that stays open too long was interrupted.
NEXT = {
    "": ("queued",),
    "queued": ("running", "cancelling", "interrupted"),
    "running": ("completed", "completed_with_errors", "failed", "cancelled", "cancelling", "awaiting_review", "interrupted"),
    "awaiting_review": ("queued", "cancelled"),
    "cancelling": ("cancelled", "interrupted"),
    "completed": (), "completed_with_errors": (), "failed": (), "cancelled": (), "interrupted": (),
}
#: States that a crash interrupts.
OPEN = ("queued", "running", "cancelling")
STATES = tuple(NEXT)
_NUMBER = {s: i for i, s in enumerate(STATES)}
#: Seconds without an event after which an open run counts as interrupted.
TIMEOUT = 3600


def step(state: str, told: str, late: bool) -> tuple[str, bool]:
    """The state after an event and whether it was accepted; ``late``: the run stayed open too long before it."""
    if late and state in OPEN:
        state = "interrupted"
    return (told, True) if told in NEXT[state] else (state, False)


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the first and the last run of a partition: what its events there make of each state."""
    ends: list[list] = []
    part = None
    for batch in batches:
        for part, run, told, late in zip(*(batch[n].to_pylist() for n in ("_part", "run_id", "state", "late")), strict=True):
            if not ends or ends[-1][0] != run:
                if len(ends) == 2:
                    ends.pop()
                ends.append([run, list(STATES)])
            ends[-1][1] = [step(s, told, late)[0] for s in ends[-1][1]]
    for run, to in ends:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([run], batch.schema.field("run_id").type), pa.array([[_NUMBER[s] for s in to]], pa.list_(pa.int32()))], ["_part", "run_id", "to"])


def run_events(events: DataFrame, timeout: int = TIMEOUT) -> DataFrame:
    """Events (run_id, at, ord, state) with whether each was accepted and the state after it; repeated ones (one ord) count once.

    A run's events are range-partitioned by time, so a run may go on over many partitions. What a partition's events make of
    any state is a map of ten states; the maps of the runs that go on, two a partition, give the state that each begins with.
    """
    once = events.select("run_id", "at", "ord", "state").groupBy("run_id", "ord").agg(F.min_by(F.struct("at", "state"), F.struct("at", "state")).alias("e")).select("run_id", "ord", "e.*")
    spaced = scan(once, ["run_id"], [F.col("at"), F.col("ord")], before=("lag", F.col("at")))
    late = F.coalesce(F.unix_micros("at") - F.unix_micros("before") > timeout * 1_000_000, F.lit(False))
    n = max(1, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["run_id", "at", "ord"]
    dealt = spaced.select("run_id", "at", "ord", "state", late.alias("late")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = settled(dealt.withColumn("_part", F.spark_partition_id()))
    key = dealt.schema["run_id"]
    told = dealt.mapInArrow(_maps, T.StructType([T.StructField("_part", T.IntegerType()), key, T.StructField("to", T.ArrayType(T.IntegerType()))])).orderBy("_part", "run_id").collect()
    begin, run, state = {}, object(), 0
    for r in told:
        if r.run_id != run:
            run, state = r.run_id, 0
        begin[r._part, r.run_id] = state
        state = r.to[state]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, state = object(), ""
        for batch in batches:
            ok, after = [], []
            for part, own, told, late in zip(*(batch[n].to_pylist() for n in ("_part", "run_id", "state", "late")), strict=True):
                if own != run:
                    run, state = own, STATES[begin.get((part, own), 0)]
                state, accepted = step(state, told, late)
                ok.append(accepted)
                after.append(state)
            yield pa.RecordBatch.from_arrays([*batch.select(["run_id", "at", "ord", "state"]).columns, pa.array(ok), pa.array(after)], ["run_id", "at", "ord", "state", "accepted", "after"])

    return dealt.mapInArrow(judged, dealt.select("run_id", "at", "ord", "state").schema.add("accepted", "boolean").add("after", "string"))


def run_states(events: DataFrame, timeout: int = TIMEOUT) -> DataFrame:
    """run_id, state, accepted, refused: the last state of each run, interrupted if it was left open, and how many events were taken or not."""
    told = run_events(events, timeout).groupBy("run_id").agg(F.max_by("after", F.struct("at", "ord")).alias("last"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))
    return told.select("run_id", F.when(F.col("last").isin(*OPEN), "interrupted").otherwise(F.col("last")).alias("state"), "accepted", "refused")


def saves(changes: DataFrame) -> DataFrame:
    """Saves (item, at, expected, content) with whether each was taken, the version it made, and what it replaced.

    A save is taken only if the version it was made from (``expected``, the time of the save before it; null: whichever) is
    the current one when it comes, so each verdict depends on the earlier ones. A task reads the saves of an item in
    order and keeps its current version alone, however many saves there are. Saves at one time are ordered by content.
    """
    fields = ["item", "at", "expected", "content"]
    dealt = changes.select(*fields).repartition("item").sortWithinPartitions("item", "at", F.col("expected").asc_nulls_first(), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, current, version, held = object(), None, 0, None
        for batch in batches:
            taken, versions, replaced = [], [], []
            for own, at, expected, content in zip(*(batch[n].to_pylist() for n in fields), strict=True):
                if own != item:
                    item, current, version, held = own, None, 0, None
                ok = expected is None or expected == current
                taken.append(ok)
                replaced.append(held if ok else None)
                if ok:
                    current, version, held = at, version + 1, content
                versions.append(version)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken), pa.array(versions, pa.int64()), pa.array(replaced, batch.schema.field("content").type)], [*fields, "taken", "version", "replaced"])

    more = [T.StructField("taken", T.BooleanType()), T.StructField("version", T.LongType()), T.StructField("replaced", dealt.schema["content"].dataType)]
    return dealt.mapInArrow(run, T.StructType([*dealt.schema.fields, *more]))
