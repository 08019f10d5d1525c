"""Keeps the planes' queries running, each for itself.

A listener hears of a query that ended with an error; its axis is started again after a pause
that doubles with every failure in a row and shrinks back once an epoch went through. One
thread owns all that, so nothing is locked, and no axis waits for another. A query that is
stopped, or ends without an error, stays ended.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from queue import Empty, Queue
from threading import Thread

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

# Seconds before the first restart, and at most.
FIRST_PAUSE, LONGEST_PAUSE = 1.0, 30.0

Starter = Callable[[], StreamingQuery]


@dataclass
class Axis:
    """What is known of one axis. ``state`` is starting, running, waiting, ended or given up."""

    starter: Starter
    state: str = "starting"
    query: StreamingQuery | None = None
    run: str = ""
    failures: int = 0  # in a row
    restarts: int = 0
    error: str = ""
    due: float = 0.0


class _Ears(StreamingQueryListener):
    def __init__(self, heard: Queue):
        self.heard = heard

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            self.heard.put(("progress", str(event.progress.runId), ""))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.heard.put(("ended", str(event.runId), event.exception or ""))


class Supervisor:
    """``Supervisor(spark, {"usage": lambda: start_usage(...), ...}).start()``

    ``budget`` is how many failures in a row an axis may have before it is given up; without
    one it is tried for ever.
    """

    def __init__(
        self,
        spark: SparkSession,
        starters: dict[str, Starter],
        *,
        first_pause: float = FIRST_PAUSE,
        longest_pause: float = LONGEST_PAUSE,
        budget: int | None = None,
    ):
        self.spark, self.first, self.longest, self.budget = spark, first_pause, longest_pause, budget
        self.axes = {name: Axis(starter) for name, starter in starters.items()}
        self._heard: Queue = Queue()
        self._ears = _Ears(self._heard)
        self._thread = Thread(target=self._run, daemon=True)

    def start(self) -> Supervisor:
        self.spark.streams.addListener(self._ears)
        self._thread.start()
        return self

    def stop(self) -> None:
        """Stops watching first and then every query, so none is started again."""
        self._heard.put(("stop", "", ""))
        self._thread.join()
        self.spark.streams.removeListener(self._ears)
        for axis in self.axes.values():
            if axis.query is not None:
                axis.query.stop()

    def wait(self, done: Callable[[dict[str, Axis]], bool], seconds: float = 60) -> bool:
        """Whether ``done`` became true of the axes within so many seconds."""
        end = time.monotonic() + seconds
        while not done(self.axes):
            if time.monotonic() > end:
                return False
            time.sleep(0.05)
        return True

    def _run(self) -> None:
        while True:
            now = time.monotonic()
            for axis in self.axes.values():
                if axis.state in ("starting", "waiting") and axis.due <= now:
                    self._begin(axis)
            due = [a.due for a in self.axes.values() if a.state == "waiting"]
            try:
                what, run, error = self._heard.get(timeout=max(0.0, min(due) - time.monotonic()) if due else None)
            except Empty:
                continue
            if what == "stop":
                return
            axis = next((a for a in self.axes.values() if a.run == run), None)
            if axis is None:
                continue
            if what == "progress":
                axis.failures = 0
            elif error:
                self._failed(axis, error)
            else:
                axis.state = "ended"

    def _begin(self, axis: Axis) -> None:
        axis.restarts += axis.state == "waiting"
        try:
            axis.query = axis.starter()
        except Exception as error:  # noqa: BLE001 - an axis that can't start must not stop the others
            self._failed(axis, str(error))
        else:
            # Heard events wait in the queue, so this query's are looked at after it is known.
            axis.run, axis.state = str(axis.query.runId), "running"

    def _failed(self, axis: Axis, error: str) -> None:
        axis.failures += 1
        axis.error, axis.run = error, ""
        if self.budget is not None and axis.failures > self.budget:
            axis.state = "given up"
            return
        axis.state = "waiting"
        axis.due = time.monotonic() + min(self.longest, self.first * 2 ** min(axis.failures - 1, 30))
