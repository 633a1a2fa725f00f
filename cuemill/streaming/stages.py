"""Stage events of a run, and cancellation between its stages."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

# How far a run is when a stage begins.
PERCENT = {"converting": 10, "transcribing": 35, "translating": 65}


class Cancelled(BaseException):
    """A run that was asked to stop and did so between two stages; not an error that a stage may catch."""


class Stages:
    """Runs the stages of a batch or a stream, tells of them, and stops between them once `cancel` is set.

    on_event gets a dict: stage, message, completed, total and, where it is known, percent.
    """

    def __init__(self, on_event: Callable[[dict], None] | None = None, cancel: threading.Event | None = None):
        self.on_event, self.cancel = on_event, cancel or threading.Event()
        self.completed = self.total = 0

    def emit(self, stage: str, message: str, **details) -> None:
        if self.on_event:
            known = {"percent": PERCENT[stage]} if stage in PERCENT else {}
            self.on_event({"stage": stage, "message": message, "completed": self.completed, "total": self.total, **known, **details})

    def check(self) -> None:
        if self.cancel.is_set():
            self.emit("cancelled", "stopped between two stages")
            raise Cancelled

    def run(self, rows: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
        """rows after all steps (stage, rows -> rows).  A step that is to be done before the next begins materialises its rows."""
        self.completed, self.total = 0, len(steps)
        for stage, step in steps:
            self.check()
            self.emit(stage, f"begins {stage}")
            rows = step(rows)
            self.completed += 1
            self.check()
        return rows

    def batches(self, process: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """process for foreachBatch: a batch of which cancellation was asked before is not begun, and its offsets stay open."""

        def one(rows: DataFrame, batch: int) -> None:
            if self.cancel.is_set():
                raise RuntimeError("cancelled")
            self.emit("batch", f"begins batch {batch}", batch=batch)
            process(rows, batch)
            self.completed += 1

        return one

    def watch(self, query: StreamingQuery, every: float = 0.2) -> bool:
        """Waits for a query; stops it once cancellation is asked for.  Whether it ended by itself."""
        while not query.awaitTermination(every):
            if self.cancel.is_set():
                query.stop()
                self.emit("cancelled", "stopped between two batches")
                return False
        return True
