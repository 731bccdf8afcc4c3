"""Durations and progress, in the log of this package."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger("kilnwork")


@contextmanager
def timed(label: str) -> Iterator[None]:
    """Logs how long a block took, also if it failed."""
    began = time.perf_counter()
    try:
        yield
    finally:
        log.info("%s: Duration: %.3f s", label, time.perf_counter() - began)


class Progress(StreamingQueryListener):
    """Logs each batch of the session's streams: add with spark.streams.addListener(Progress())."""

    def onQueryStarted(self, event) -> None:
        log.info("stream %s started", event.name or event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        log.info("stream %s, batch %d: %d rows, %s ms", p.name or p.id, p.batchId, p.numInputRows, p.durationMs.get("triggerExecution"))

    def onQueryIdle(self, event) -> None:
        log.debug("stream %s is idle", event.id)

    def onQueryTerminated(self, event) -> None:
        log.info("stream %s ended%s", event.id, f": {event.exception}" if event.exception else "")
