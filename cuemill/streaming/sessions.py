"""Gap sessions on a stream: words that come in any order, sealed as soon as nothing can join them any more."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.intervals import strict

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Words in one value of the state.
BLOCK = 1000


def _blocks(words: list[tuple]) -> list[tuple[str]]:
    """Words as few values of the state: a value costs a call to the store, whatever it holds."""
    return [(json.dumps(words[i : i + BLOCK]),) for i in range(0, len(words), BLOCK)]


def _millis(seconds: float) -> int:
    """The first millisecond that is not before a time."""
    return math.ceil(seconds * 1000)


class _Sessions(StatefulProcessor):
    """State of one medium: the words that the watermark has not passed, and the session that is open.

    A word waits until the watermark is at its start: all that start before it are there by then.  One timer a medium stands
    at the next time when something can happen - the first waiting word's start, or the end of the open session's gap.
    The waiting words of a batch are kept in blocks, not each by itself.
    """

    def __init__(self, gap: float, joiner: str, key: str):
        self.gap, self.joiner, self.key = gap, joiner, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "words string")
        self.open = handle.getValueState("open", "segment long, start double, end double, n_words long, text string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, words = math.inf, []
        for w in rows:
            words.append((w["start"], w["seq"], w["end"], w["text"]))
            first = min(first, w["start"])
            if len(words) == BLOCK:
                self.waiting.appendList(_blocks(words))
                words = []
        if words:
            self.waiting.appendList(_blocks(words))
        self._wake(_millis(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        words = sorted((w for (block,) in self.waiting.get() for w in json.loads(block)), key=lambda w: w[:2])
        ready = [w for w in words if w[0] <= now]
        later = words[len(ready) :]
        if ready:
            self.waiting.clear()
            if later:
                self.waiting.put(_blocks(later))
        session = tuple(self.open.get()) if self.open.exists() else None
        texts = [] if session is None or session[4] is None else [session[4]]
        whole = lambda s: (*s[:4], self.joiner.join(texts) if texts else None)
        done = []
        for start, _, end, text in ready:
            if session is None or session[3] and start - session[2] > self.gap:
                if session:
                    done.append(whole(session))
                session, texts = (session[0] + 1 if session else 0, start, end, 0), []
            elif not session[3]:
                session = (session[0], start, end, 0)
            session = (session[0], session[1], end, session[3] + 1)
            texts += [] if text is None else [text]
        if session:
            if session[3] and now - session[2] >= self.gap and not (later and later[0][0] - session[2] <= self.gap):
                done.append(whole(session))
                session, texts = (session[0] + 1, 0.0, 0.0, 0), []  # only its number is left: the next word opens it
            self.open.update(whole(session))
        times = [_millis(later[0][0])] if later else []
        if session and session[3]:
            times.append(_millis(session[2] + self.gap))
        if times:
            passed = int(timerValues.getCurrentWatermarkInMs())
            self._wake(max(min(times), passed + 1), passed)
        told = Row(self.key, "segment", "start", "end", "n_words", "text")
        for d in done:
            yield told(key[0], *d)

    def _wake(self, at: int, passed: int = -1) -> None:
        """Has the medium woken at `at`, or earlier if a timer says so; a timer at `passed` or before is the one that just ran."""
        timers = [t for t in self.handle.listTimers() if t > passed]
        if any(t <= at for t in timers):
            return
        for t in timers:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)


def gap_sessions(words: DataFrame, threshold: float = 0.8, delay: str = "10 minutes", joiner: str = "", key: str = "media_id") -> DataFrame:
    """The rows of intervals.gap_segments for streamed words (key, seq, start, end, text), each once its session is closed.

    A word's start, in seconds since 1970, is its event time.  Words may come in any order and batch, up to `delay` behind
    the newest; what is later is lost, as the watermark has it.  Among the words of a medium seq is to follow start, which
    also holds for words of one start.  The newest sessions stay open until words of any medium move the clock past them.

    State is keyed by medium: it holds the words of the last `delay`, the open session and one timer; closed sessions
    leave nothing but their number.  The session needs the RocksDB state store (option STORE), which snapshots changes
    alone.  Words that strict() refuses are left out before they reach the state.
    """
    session = words.sparkSession
    if session.conf.get(STORE, "") != ROCKS:
        raise RuntimeError(f"{STORE} is to be {ROCKS}")
    gap = max(0.1, threshold)
    good = strict(words).filter("valid").select(key, "seq", "start", "end", "text")
    timed = good.withColumn("at", F.timestamp_micros(F.floor(F.col("start") * 1_000_000).cast("long"))).withWatermark("at", delay)
    kind = words.schema[key].dataType
    shape = T.StructType([T.StructField(key, kind), *T.StructType.fromDDL("segment long, start double, end double, n_words long, text string").fields])
    found = timed.groupBy(key).transformWithState(_Sessions(gap, joiner, key), shape, "Append", "EventTime")
    return found.withColumn("text", F.trim("text")).filter("text <> ''")
