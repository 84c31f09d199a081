"""States of runs as their events arrive: late events in order, repeated ones once, runs left open interrupted by a timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.transitions import OPEN, TIMEOUT, step

_OUT = "run_id string, at long, ord long, state string, accepted boolean, after string"


class Runs(StatefulProcessor):
    """Holds a run's events until the watermark has passed them, then judges them in the order of their time.

    State of a run: its waiting events, its state, and the time (ms) of its last event.
    """

    def __init__(self, timeout: int = TIMEOUT) -> None:
        self.timeout = timeout * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, ord long", "state string")
        self.current = handle.getValueState("current", "state string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for at, ord_, state in zip(batch["ms"].tolist(), batch["ord"].tolist(), batch["state"].tolist(), strict=True):
                self.waiting.updateValue((at, ord_), (state,))
                self.handle.registerTimer(max(at, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        state, last = self.current.get() if self.current.exists() else ("", None)
        out = []
        due = sorted((k, v[0]) for k, v in self.waiting.iterator() if k[0] <= now)
        for (at, ord_), told in due:
            state, accepted = step(state, told, last is not None and at - last > self.timeout)
            last = at
            out.append((key[0], at, ord_, told, accepted, state))
            self.waiting.removeKey((at, ord_))
        if due:
            self.handle.registerTimer(last + self.timeout + 1)
        elif state in OPEN and last is not None and now > last + self.timeout:
            state = "interrupted"
            out.append((key[0], last + self.timeout, -1, state, True, state))
        if last is not None:
            self.current.update((state, last))
        yield pd.DataFrame(out, columns=["run_id", "at", "ord", "state", "accepted", "after"])

    def close(self) -> None:
        pass


def run_states(events: DataFrame, late: str, timeout: int = TIMEOUT) -> DataFrame:
    """Judged events of a stream (run_id string, at timestamp, ord, state): accepted or not, the state after each.

    A run without an event for ``timeout`` seconds is interrupted; that event has ord -1. The session must keep its state in RocksDB.
    """
    ms = "unix_millis(at) AS ms"
    timed = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["run_id", "ord"]).selectExpr("run_id", "at", ms, "ord", "state")
    return timed.groupBy("run_id").transformWithStateInPandas(Runs(timeout), _OUT, "Append", "EventTime")
