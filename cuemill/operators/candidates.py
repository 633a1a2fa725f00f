"""Choice among transcriptions of a segment, and recovery of suspicious ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import Thresholds, candidate_key, metrics, reasons


def with_quality(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """df (text, compression_ratio, avg_logprob, no_speech_prob) with its repetition metrics and reasons."""
    return df.withColumn("_m", metrics(F.col("text"))).select(*df.columns, "_m.*").withColumn("reasons", reasons(t))


def best(candidates: DataFrame, key: str, t: Thresholds = Thresholds(), seq: str = "seq") -> DataFrame:
    """The best candidate of each key, ties to the lowest seq: a grouped minimum, combined before the shuffle."""
    rows = candidates.withColumn("_key", candidate_key(t, seq))
    kept = F.struct(*[c for c in candidates.columns if c != key])
    return rows.groupBy(key).agg(F.min_by(kept, "_key").alias("_best")).select(key, "_best.*")


def recovered(candidates: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """One row for each segment: the first transcription if it is healthy, else the best of its retries.

    candidates: with_quality rows of segment_id, round, pass, pos; round 0 is the first transcription.  Retries count up to
    the first pass with a healthy candidate; accepted tells whether the choice is healthy - if not, the segment is to
    be rejected.
    """
    healthy = F.size("reasons") == 0
    rows = candidates.withColumn("seq", F.struct("round", "pass", "pos")).withColumn("_ok", healthy)
    w = Window.partitionBy("segment_id")
    stop = F.min(F.when(F.col("_ok"), F.struct("round", "pass"))).over(w)
    rows = rows.withColumn("_stop", stop).filter(F.col("_stop").isNull() | (F.struct("round", "pass") <= F.col("_stop")))
    first = F.max((F.col("round") == 0) & F.col("_ok")).over(w)
    rows = rows.withColumn("_first", first).filter((F.col("_first") & (F.col("round") == 0)) | (~F.col("_first") & (F.col("round") > 0)))
    out = best(rows.drop("_stop", "_first"), "segment_id", t)
    return out.withColumnRenamed("_ok", "accepted").drop("seq")
