"""Cue lists side by side: alignment, neighbours, review passes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import apply_edits, clamp01


def misaligned(a: DataFrame, b: DataFrame, key="media_id") -> DataFrame:
    """The places where two cue lists differ: missing on a side, or another start or end.  a, b: key, index, start, end."""
    left = a.select(key, "index", F.struct("start", "end").alias("a"))
    right = b.select(key, "index", F.struct("start", "end").alias("b"))
    both = left.join(right, [key, "index"], "full_outer")
    kind = F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").when(~(F.col("a.start").eqNullSafe(F.col("b.start")) & F.col("a.end").eqNullSafe(F.col("b.end"))), "changed time")
    return both.select(key, "index", kind.alias("kind")).filter("kind is not null")


def with_source(cues: DataFrame, source: DataFrame, key="media_id") -> DataFrame:
    """cues with source_text: the text of the source's cue of that index, empty where there is none."""
    right = source.select(key, "index", F.col("text").alias("source_text"))
    return cues.join(right, [key, "index"], "left").withColumn("source_text", F.coalesce("source_text", F.lit("")))


def with_neighbours(cues: DataFrame, key="media_id") -> DataFrame:
    """cues with the texts before and after, empty at the ends."""
    w = Window.partitionBy(key).orderBy("index")
    return cues.withColumn("before", F.coalesce(F.lag("text").over(w), F.lit(""))).withColumn("after", F.coalesce(F.lead("text").over(w), F.lit("")))


def reviewed(cues: DataFrame, reviewers: list[tuple[str, Callable[[DataFrame], DataFrame]]], key="media_id") -> tuple[DataFrame, DataFrame]:
    """(cues, issues) after reviewers in turn, each of whom sees the texts its predecessors left.

    A reviewer maps cues to rows (key, index, edits, confidence); edits that don't fit are passed over.  Times are never
    touched, so the list stays aligned.  issues: key, index, engine, before, after, confidence.
    """
    issues = None
    for engine, review in reviewers:
        found = review(cues).select(key, "index", "edits", clamp01(F.col("confidence")).alias("confidence"))
        joined = cues.join(found, [key, "index"], "left").withColumn("_text", F.when(F.col("edits").isNotNull(), apply_edits(F.col("text"), F.col("edits"))).otherwise(F.col("text")))
        changed = joined.filter("_text <> text").select(key, "index", F.lit(engine).alias("engine"), F.col("text").alias("before"), F.col("_text").alias("after"), "confidence")
        issues = changed if issues is None else issues.unionByName(changed)
        cues = joined.withColumn("text", F.col("_text")).drop("_text", "edits", "confidence")
    return cues, issues
