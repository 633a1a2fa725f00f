"""Timed segments: validation policies, gap segmentation, diagnostics.

Every operator orders the rows of a medium by `seq`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import finite

EPSILON = 0.001
OVERLAP = 10.0
MOST_CUES = 100_000


def _order(key, seq="seq"):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(seq)


def _faults(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in rules]))


def strict(df: DataFrame) -> DataFrame:
    """df with valid: finite times, start not negative, end after start."""
    return df.withColumn("valid", finite(F.col("start")) & finite(F.col("end")) & F.coalesce((F.col("start") >= 0) & (F.col("end") > F.col("start")), F.lit(False)))


def lenient(df: DataFrame, key="media_id") -> DataFrame:
    """For each medium its first fault and how many cues have no text: an end may equal its start, a text may be empty."""
    fault = F.when(F.col("start") < 0, "negative start").when(F.col("end") < F.col("start"), "end before start")
    return df.groupBy(key).agg(
        F.min_by(F.when(fault.isNotNull(), F.struct("seq", fault.alias("fault"))), F.when(fault.isNotNull(), F.col("seq")))["fault"].alias("fault"),
        F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("n_empty"),
        F.count("*").alias("n_cues"),
    )


def all_faults(df: DataFrame, key="media_id") -> DataFrame:
    """df with faults: every fault of each cue, none raised; order is judged by the previous start."""
    before = F.lag("start").over(_order(key))
    return df.withColumn(
        "faults",
        _faults((F.col("start") < 0, "negative start"), (F.col("end") < F.col("start"), "end before start"), (F.col("start") + EPSILON < F.coalesce(before, F.lit(-1.0)), "unordered")),
    )


def medium_valid(df: DataFrame, key="media_id") -> DataFrame:
    """Whether each medium has no fault at all."""
    return all_faults(df, key).groupBy(key).agg((F.sum(F.size("faults")) == 0).alias("valid"))


def speech(df: DataFrame, key="media_id") -> DataFrame:
    """For each medium the first fault for synthesis: a time that is not after its start, or a cue before the previous end."""
    before = F.lag("end").over(_order(key))
    rows = df.withColumn("_fault", F.when((F.col("start") < 0) | (F.col("end") <= F.col("start")), "invalid time").when(F.col("start") < before, "overlap"))
    return rows.groupBy(key).agg(F.min_by("_fault", F.when(F.col("_fault").isNotNull(), F.col("seq"))).alias("fault"), F.count("*").alias("n_cues"))


def regenerated(df: DataFrame, previous: DataFrame | None = None, key="media_id") -> DataFrame:
    """For each medium its faults after regeneration, counted: first lenient fault, order, overlaps above 10 s, and counts.

    A cue without numeric times is a fault of its own and is not the one before the next.  previous: key, n_previous.
    """
    numeric = F.col("start").isNotNull() & F.col("end").isNotNull()
    timed = df.filter(numeric)
    w = _order(key)
    start_before, end_before = F.coalesce(F.lag("start").over(w), F.lit(-1.0)), F.coalesce(F.lag("end").over(w), F.lit(-1.0))
    timed = timed.withColumn("_unordered", F.col("start") + EPSILON < start_before)
    timed = timed.withColumn("_overlap", (F.col("start") + EPSILON < end_before) & (end_before - F.col("start") > OVERLAP))
    order = timed.groupBy(key).agg(F.count_if("_unordered").alias("n_unordered"), F.count_if("_overlap").alias("n_overlap"))
    base = df.groupBy(key).agg(F.count("*").alias("n_cues"), F.count_if(~numeric).alias("n_unreadable"))
    first = lenient(timed, key).select(key, "fault")
    out = base.join(order, key, "left").join(first, key, "left").fillna(0, ["n_unordered", "n_overlap"])
    if previous is not None:
        out = out.join(previous, key, "left")
    else:
        out = out.withColumn("n_previous", F.lit(0).cast("long"))
    known = F.coalesce("n_previous", F.lit(0))
    out = out.withColumn("too_many", ((known > 0) & (F.col("n_cues") > known * 10 + 100)) | (F.col("n_cues") > MOST_CUES))
    sound = F.col("fault").isNull() & (F.col("n_unreadable") + F.col("n_unordered") + F.col("n_overlap") == 0) & ~F.col("too_many")
    return out.withColumn("valid", sound).drop("n_previous")


def gap_segments(words: DataFrame, threshold: float = 0.8, joiner: str = "", key="media_id") -> DataFrame:
    """Words as segments: a new one where a word starts more than `threshold` (0.1 s at least) after the previous word's end.

    Words that strict() refuses are left out first.  A segment runs from its first word's start to its last word's end -
    also where an earlier word ends later - and holds their texts, trimmed; without text it is dropped.
    """
    gap = max(0.1, threshold)
    good = strict(words).filter("valid")
    w = _order(key)
    new = F.coalesce((F.col("start") - F.lag("end").over(w) > gap).cast("int"), F.lit(0))
    cut = good.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = cut.groupBy(*([key] if isinstance(key, str) else key), "segment").agg(
        F.min_by("start", "seq").alias("start"),
        F.max_by("end", "seq").alias("end"),
        F.count("*").alias("n_words"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), joiner).alias("text"),
    )
    return parts.withColumn("text", F.trim("text")).filter("text <> ''").withColumn("segment", F.col("segment").cast("long"))


def diagnostics(df: DataFrame, key="media_id") -> DataFrame:
    """count, first_start, last_end, and count and largest of the gaps and overlaps beyond a millisecond."""
    gap = F.col("start") - F.lag("end").over(_order(key))
    rows = df.withColumn("_gap", gap)
    over = F.when(F.col("_gap") < -EPSILON, -F.col("_gap"))
    wide = F.when(F.col("_gap") > EPSILON, F.col("_gap"))
    return rows.groupBy(key).agg(
        F.count("*").alias("n_cues"),
        F.min_by("start", "seq").alias("first_start"),
        F.max_by("end", "seq").alias("last_end"),
        F.count(wide).alias("n_gaps"),
        F.coalesce(F.max(wide), F.lit(0.0)).alias("max_gap"),
        F.count(over).alias("n_overlaps"),
        F.coalesce(F.max(over), F.lit(0.0)).alias("max_overlap"),
    )


def in_order(df: DataFrame, key="media_id") -> DataFrame:
    """Rows of each medium sorted by start, end and seq, numbered anew."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("start", "end", "seq")))
