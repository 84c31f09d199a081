"""Frames of an event stream from the progress of running queries."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class EventFrames(StreamingQueryListener):
    """Sends a frame when a query starts, for each batch that it has handled, and when it ends or fails.

    ``send`` takes the text of a frame. A reader that has gone (a broken or reset connection) gets no more of a query's
    frames, and ``gone`` is called with the query's id, so that the query can be stopped.
    """

    def __init__(self, send: Callable[[str], None], gone: Callable[[str], None] = lambda _: None) -> None:
        self.send, self.gone, self.left = send, gone, set()

    def _emit(self, query: str, event: dict) -> None:
        if query in self.left:
            return
        try:
            self.send("data: " + json.dumps(event) + "\n\n")
        except (BrokenPipeError, ConnectionResetError):
            self.left.add(query)
            self.gone(query)

    def onQueryStarted(self, event) -> None:
        self._emit(str(event.id), {"type": "start", "stream_id": str(event.id), "name": event.name})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._emit(str(p.id), {"type": "progress", "stream_id": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "ms": p.batchDuration})

    def onQueryIdle(self, event) -> None:
        self._emit(str(event.id), {"type": "idle", "stream_id": str(event.id)})

    def onQueryTerminated(self, event) -> None:
        failed = event.exception
        self._emit(str(event.id), {"type": "error", "stream_id": str(event.id), "error": failed[:2000]} if failed else {"type": "complete", "stream_id": str(event.id)})
