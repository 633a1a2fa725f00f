"""Gap sessions on a stream against the batch operator."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import Row

from cuemill.operators import intervals
from cuemill.streaming import sessions

WORDS = "media_id string, seq long, start double, end double, text string"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(sessions.STORE, None)
    spark.conf.set(sessions.STORE, sessions.ROCKS)
    yield spark
    spark.conf.unset(sessions.STORE) if old is None else spark.conf.set(sessions.STORE, old)


def media(seed, n=120):
    r = random.Random(seed)
    rows = []
    for m in range(5):
        t = 1000.0 + r.random()
        for k in range(n):
            t += r.choice([0.0, 0.05, 0.3, 0.8, 0.80001, 1.0, 3.0])
            end = t + r.choice([0.01, 0.2, 0.2, 2.5, 0.0, -1.0])
            rows.append((f"m{m}", k, t, end, r.choice([" a", "b ", "", None, "ç"])))
        rows += [(f"m{m}", n, float("nan"), t, "x"), (f"m{m}", n + 1, None, None, "y")]
    return rows


CLOCK = [("clock", k, 1e6 + k, 1e6 + k + 0.5, "tick") for k in range(2)]


def run(spark, path, out, check, **options):
    words = spark.readStream.schema(WORDS).option("maxFilesPerTrigger", 1).parquet(path)
    got = sessions.gap_sessions(words, delay="30 seconds", **options)
    q = got.writeStream.format("parquet").option("checkpointLocation", check).option("path", out).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(600) is not False
    assert q.exception() is None
    return q


def shuffled(rows, span, seed):
    """rows by start, each up to `span` seconds out of place: what a delay of 30 seconds allows."""
    r = random.Random(seed)
    good = sorted(rows, key=lambda w: (w[2] if w[2] is not None and w[2] == w[2] else 0) + r.uniform(0, span))
    return [good[i : i + 90] for i in range(0, len(good), 90)]


def rows_of(df):
    return Counter((r.media_id, r.segment, round(r.start, 6), round(r.end, 6), r.n_words, r.text) for r in df.collect())


@pytest.mark.parametrize("joiner", ["", "|"])
def test_a_stream_in_shuffled_batches_gives_the_segments(rocks, tmp_path, joiner):
    """Words out of order, over two starts of the query on one checkpoint, between which sessions stay open."""
    rows = media(3)
    batches = shuffled(rows, 20, 5)
    path, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for part in (batches[: len(batches) // 2], [*batches[len(batches) // 2 :], CLOCK]):
        for b in part:
            rocks.createDataFrame(b, WORDS).coalesce(1).write.mode("append").parquet(path)
        run(rocks, path, out, check, threshold=0.8, joiner=joiner)
    want = rows_of(intervals.gap_segments(rocks.createDataFrame(rows, WORDS), 0.8, joiner))
    got = rows_of(rocks.read.parquet(out).filter("media_id <> 'clock'"))
    assert got == want
    assert len(want) > 100


def test_a_session_is_told_once_it_is_closed(rocks, tmp_path):
    """A later word of any medium closes it; what is open is not told."""
    path, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rocks.createDataFrame([("a", 1, 100.0, 100.4, "one"), ("a", 0, 99.9, 100.0, "zero ")], WORDS).coalesce(1).write.mode("append").parquet(path)
    run(rocks, path, out, check)
    assert rocks.read.schema("media_id string, segment long, start double, end double, n_words long, text string").parquet(out).count() == 0
    rocks.createDataFrame([("b", 0, 140.0, 141.0, "far")], WORDS).coalesce(1).write.mode("append").parquet(path)
    run(rocks, path, out, check)
    got = [tuple(r) for r in rocks.read.parquet(out).collect()]
    assert got == [("a", 0, 99.9, 100.4, 2, "zero one")]


def test_words_wait_in_blocks():
    """2500 words of a medium in one batch are three values of the state."""
    values, timers = [], []

    class Handle:
        getListState = lambda self, *a: self
        getValueState = getListState
        appendList = lambda self, v: values.extend(v)
        listTimers = lambda self: timers
        registerTimer = lambda self, at: timers.append(at)

    words = [Row(start=9.0 + k, seq=k, end=9.5 + k, text="é" if k % 2 else None) for k in range(2500)]
    p = sessions._Sessions(0.8, "", "media_id")
    p.init(Handle())
    assert list(p.handleInputRows(("a",), iter(words), None)) == []
    kept = [tuple(w) for (block,) in values for w in json.loads(block)]
    assert len(values) == 3 and timers == [9000]
    assert kept == [(w.start, w.seq, w.end, w.text) for w in words]


def test_state_store_is_asked_for(spark):
    with pytest.raises(RuntimeError, match="RocksDB"):
        sessions.gap_sessions(spark.createDataFrame([], WORDS))
