"""Progress of streams by listener: what a batch counted, without another job over its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .stages import Stages

NAME = "cuemill"


def observed(rows: DataFrame, name: str = NAME, **measures: Column) -> DataFrame:
    """rows, of which each batch counts `rows` and the measures given (aggregates) while it is processed anyway."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in measures.items()))


class Progress(StreamingQueryListener):
    """Tells Stages of each batch of a query (by name; all, if null) as it ends, with what observed() counted in it.

    Events: "stream" when it starts, "batch" with batch, input_rows, seconds and the measures, and "completed" or "failed".
    totals adds up what the batches counted.  Spark calls listeners one event after the other, behind the query: stop()
    waits for those that are on their way.
    """

    def __init__(self, stages: Stages, query: str | None = None, name: str = NAME, on_batch: Callable[[dict], None] | None = None):
        self.stages, self.query, self.name, self.on_batch = stages, query, name, on_batch
        self.totals: dict[str, float] = {}
        self.ids: set = set()

    def onQueryStarted(self, event) -> None:
        if self.query in (None, event.name):
            self.ids.add(event.id)
            self.stages.emit("stream", f"starts {event.name or event.id}")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.id not in self.ids:
            return
        counted = p.observedMetrics.get(self.name)
        got = counted.asDict() if counted is not None else {}
        if not got.get("rows", p.numInputRows):  # Spark also tells that nothing has come
            return
        for k, v in got.items():
            self.totals[k] = self.totals.get(k, 0) + (v or 0)
        self.stages.completed += 1
        told = {"batch": p.batchId, "input_rows": p.numInputRows, "seconds": p.batchDuration / 1000, **got}
        self.stages.emit("batch", f"ended batch {p.batchId}", **told)
        if self.on_batch:
            self.on_batch(told)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.id in self.ids:
            self.stages.emit("failed" if event.exception else "completed", event.exception or "the stream has ended")

    def start(self, spark: SparkSession) -> Progress:
        spark.streams.addListener(self)
        return self

    def stop(self, spark: SparkSession) -> None:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        spark.streams.removeListener(self)
