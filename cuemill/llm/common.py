"""Helpers that the corpus operators share: tables in the shared folder, running totals over sorted partitions."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import time
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
SPACE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; where it is one file that fewer tasks would read than there are cores, dealt over all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) == 1 and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in a local session without the setting, as in tests, one of its own."""
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not got:
        got = spark.conf.get("spark.cuemill.scratch", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is to name a folder that all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="cuemill-")
        spark.conf.set("spark.cuemill.scratch", got)
    return got.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what follows does not depend on its lineage."""
    path = f"{shared_dir(df.sparkSession)}/cuemill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what store() wrote and nothing will read again; leaves files that it did not write."""
    spark = df.sparkSession
    home = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).toUri().getPath()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        if path.getParent().toUri().getPath() == f"{home}/cuemill":
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, row_bytes: int, most_mb: int = 32) -> DataFrame:
    """df with a broadcast hint if `rows` rows of `row_bytes` are within the bound; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= most_mb << 20 else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_field(df: DataFrame, name: str, kind: str) -> T.StructType:
    """df's schema and one more column; schema.add would change df's own."""
    return T.StructType([*df.schema.fields]).add(name, kind)


#: What a worker remembers between tasks: name -> (last use, what forgets it).
memories: dict[str, tuple[float, Callable[[], None]]] = {}
FORGET_S = 10


def release() -> None:
    """Gives memory that a task has freed back to the system: idle Python workers stay, and share the executor with others.

    What a worker remembers for tasks of one kind is forgotten by its tasks of other kinds, a few seconds later.
    """
    for name, (used, forget) in list(memories.items()):
        if time.monotonic() - used > FORGET_S:
            forget()
            del memories[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def lean(step, rows: int = 1000):
    """A step over Arrow batches that sees at most `rows` rows at a time and releases its memory at the end.

    Whole texts are long, so the session, too, sends batches of that size unless it is set to another than the default.
    """
    session = SparkSession.getActiveSession()
    if session and session.conf.get(BATCH) == "10000":
        session.conf.set(BATCH, str(rows))

    @functools.wraps(step)
    def run(batches):
        if memories:
            release()
        try:
            yield from step(b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows))
        finally:
            release()

    return run


def text_of(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def _running(cls: str, values: list[str], outs: list[str]):
    def step(batches):
        last, carry = None, [0] * len(values)
        for b in batches:
            if not b.num_rows:
                continue
            c = b.column(b.schema.get_field_index(cls)).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            sizes, sums = np.diff(np.r_[first, len(c)]), []
            for k, value in enumerate(values):
                v = b.column(b.schema.get_field_index(value)).to_numpy(zero_copy_only=False)
                before = np.cumsum(v) - v
                got = before - np.repeat(before[first], sizes)
                if last is not None and c[0] == last:
                    got[: first[1] if len(first) > 1 else len(c)] += carry[k]
                carry[k] = int(got[-1] + v[-1])
                sums.append(pa.array(got, pa.int64()))
            last = c[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, *sums], names=[*b.schema.names, *outs])

    return step


def running_total(df: DataFrame, cls: str, order: list[str], value: str | list[str], out: str | list[str], name: str) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of the same `cls` that come before it by `order`; both may be lists.

    cls and value are longs without nulls.  Rows are dealt out by ranges of (cls, *order, place in df), so one class, and
    any number of rows alike in cls and order, may spread over tasks; df is to be read from files, which gives rows the same
    place each time.  The sums of each task are few (one for each task and class that meet) and give the starts.
    """
    n = partitions(df.sparkSession)
    values, outs = ([value], [out]) if isinstance(value, str) else (value, out)
    keys = [cls, *order, "_place"]
    cut = df.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_place").withColumn("_pid", F.spark_partition_id())
    schema = T.StructType([*cut.schema.fields, *(T.StructField(o, T.LongType()) for o in outs)])
    cut = store(cut.mapInArrow(_running(cls, values, outs), schema), name)
    sums = store(cut.groupBy("_pid", cls).agg(*[F.sum(v).alias(f"_sum_{v}") for v in values]), f"{name}-sums")
    before = [f"sum(_sum_{v}) over (partition by {cls} order by _pid) - _sum_{v} as _start_{v}" for v in values]
    starts = sums.selectExpr("_pid", cls, *before)
    met = cut.join(small(starts, sums.count(), 16 + 8 * len(values)), ["_pid", cls])  # a row for each task and class that meet
    return met.withColumns({o: F.col(o) + F.col(f"_start_{v}") for v, o in zip(values, outs, strict=True)}).drop("_pid", *(f"_start_{v}" for v in values))
