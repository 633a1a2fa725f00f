"""Incremental runs over a drop folder: settled files, processed once, with progress after each batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.running import stored
from ..operators.state import unprocessed
from ..sources.documents import REGISTRY, append_json_lines, json_lines
from ..sources.outputs import CHUNK, located
from ..sources.storage import zip_files


#: What a poll adds to the registry's columns: by these it knows a file again without opening it.
SEEN = "source_path string, source_mtime_us long"


def hashed(files: DataFrame) -> DataFrame:
    """files (path, ...) with sha256 of their contents, read in pieces; null for a file that is gone by then."""

    def read(batches):
        for b in batches:
            out = []
            for path in b.column(b.schema.get_field_index("path")).to_pylist():
                digest = hashlib.sha256()
                try:
                    system, name = located(path)
                    with system.open_input_stream(name) as f:
                        while part := f.read(CHUNK):
                            digest.update(part)
                    out.append(digest.hexdigest())
                except FileNotFoundError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "sha256"])

    return files.mapInArrow(read, T.StructType([*files.schema.fields, T.StructField("sha256", T.StringType())]))


def pending(spark: SparkSession, root: str, registry_path: str | None, min_age_seconds: float = 60, now: str | None = None) -> DataFrame:
    """name, sha256, path, size, mtime of settled files that the registry has not seen succeed.

    A young file is left for the next poll, not lost - which a file stream, that marks it as seen, could not do.  What the
    registry has under the same path, size and time is not opened; contents are read of what is left, one file a row over
    all tasks, and by these the registry is asked again: a copy, or a file that was only touched, is not new.
    """
    files = zip_files(spark, root, min_age_seconds, now).select("path", "name", "size", "mtime")
    done = None
    if registry_path is not None:
        done = json_lines(spark, registry_path, f"{REGISTRY}, {SEEN}").filter("status = 'success'")
        known = done.select(F.col("source_path").alias("path"), "size", F.col("source_mtime_us").alias("_us")).distinct()
        files = files.withColumn("_us", F.unix_micros("mtime")).join(known, ["path", "size", "_us"], "left_anti").drop("_us")
    rows = hashed(files.repartition(spark.sparkContext.defaultParallelism, "path")).filter("sha256 is not null")
    rows = rows.select("name", "sha256", "path", "size", "mtime")
    return rows if done is None else unprocessed(rows, done.select(F.col("source_name").alias("name"), "sha256", "status"))


def poll(spark: SparkSession, root: str, registry_path: str, process: Callable[[DataFrame], DataFrame], min_age_seconds: float = 60) -> DataFrame:
    """One poll: processes what is pending and appends the outcome (name, sha256, status) to the registry; returns it, stored.

    process maps the rows of pending() to rows with name, sha256 and status; it keeps path, size and mtime where it can, so
    that later polls know the files without opening them.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(registry_path)
    known = registry_path if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path) else None
    done = stored(process(pending(spark, root, known, min_age_seconds)), "poll")  # a cache would be made again once the registry is written
    have = set(done.columns)
    seen = [c.alias(n) for c, n, needs in ((F.col("path"), "source_path", "path"), (F.col("size"), "size", "size"), (F.unix_micros("mtime"), "source_mtime_us", "mtime")) if needs in have]
    append_json_lines(done.select(F.col("name").alias("source_name"), "sha256", "status", F.current_timestamp().alias("processed_at"), *seen), registry_path)
    return done


def stream(spark: SparkSession, root: str, schema: str, process: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """A file stream of JSON lines with a step for each batch (exactly once by its checkpoint): all there is, or every so often."""
    query = spark.readStream.schema(schema).json(root).writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (query.trigger(processingTime=every) if every else query.trigger(availableNow=True)).start()


def quota_windows(requests: DataFrame, kind: str = "day") -> DataFrame:
    """Streamed or stored requests (provider, ts, amount) summed in tumbling calendar windows (UTC)."""
    if kind == "day":
        return requests.groupBy("provider", F.window("ts", "1 day").alias("w")).agg(F.sum("amount").alias("used")).select("provider", F.col("w.start").alias("window"), "used")
    return requests.groupBy("provider", F.date_trunc(kind, "ts").alias("window")).agg(F.sum("amount").alias("used"))
