"""WebVTT files: reading to cues, writing from cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..functions.times import format_time, parse_time

TIMING = r"(?:^|\n)((?:\d+:)?\d{2}:\d{2}[.,]\d{3})\s+-->\s+((?:\d+:)?\d{2}:\d{2}[.,]\d{3})"


def read(spark: SparkSession, path: str, squeeze: bool = False) -> DataFrame:
    """path, index, start, end, text of every cue of whole files; squeeze collapses white space in texts."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))
    return parsed(files, "path", squeeze)


def parsed(files: DataFrame, key: str, squeeze: bool = False) -> DataFrame:
    """key, index (from 1), start, end (seconds), text (stripped) of the cues of `document`; other blocks are skipped."""
    whole = F.regexp_replace(F.regexp_replace("document", "\r\n?", "\n"), "^\ufeff", "")
    blocks = F.filter(F.split(whole, r"\n[ \t]*\n+"), lambda b: b.rlike(TIMING))
    long = lambda c: F.when(F.size(F.split(c, ":")) == 2, F.concat(F.lit("00:"), c)).otherwise(c)
    rows = files.select(key, F.posexplode(blocks).alias("_i", "_b"))
    body = F.regexp_replace(F.regexp_replace("_b", r"(?s)^.*?-->[^\n]*\n?", ""), r"^\s+|\s+$", "")
    return rows.select(
        key,
        (F.col("_i") + 1).cast("long").alias("index"),
        parse_time(long(F.regexp_extract("_b", TIMING, 1))).alias("start"),
        parse_time(long(F.regexp_extract("_b", TIMING, 2))).alias("end"),
        (collapse(body) if squeeze else body).alias("text"),
    )


def faults(files: DataFrame, cues: DataFrame, key: str) -> DataFrame:
    """Files without a cue."""
    return files.select(key).join(cues.select(key).distinct(), key, "left_anti").withColumn("fault", F.lit("no cues found"))


def documents(cues: DataFrame, key: str = "media_id", order: str = "seq") -> DataFrame:
    """key, document: the cues of each medium in order as one WebVTT text."""
    cue = F.concat(format_time(F.col("start")), F.lit(" --> "), format_time(F.col("end")), F.lit("\n"), F.coalesce("text", F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), cue.alias("c")))), lambda x: x["c"])
    return cues.groupBy(key).agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(ordered, "\n\n"), F.lit("\n")).alias("document"))


def write(cues: DataFrame, path: str, key: str = "media_id", order: str = "seq") -> None:
    """A folder of texts, partitioned by medium, one document in each."""
    documents(cues, key, order).select(key, F.col("document").alias("value")).repartition(key).write.partitionBy(key).option("lineSep", "\n").text(path)
