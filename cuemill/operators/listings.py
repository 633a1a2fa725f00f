"""Choices among the files of output folders, and changes to whole trees of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import normal_component, suffix_of

# What counts as a video in an output, and the names of the folders in it.
VIDEO = [".mp4", ".mkv", ".mov", ".wmv", ".avi", ".webm"]
TRANSCRIPTS, MANIFESTS = "original_transcriptions", "_manifests"


def _ext(name: Column) -> Column:
    return suffix_of(name)


def is_backup(name: Column, mark: str = ".bak.") -> Column:
    """Whether a subtitle file is a numbered or dated copy; where folders are chosen for work, ".bak" alone marks it."""
    return F.contains(F.lower(name), F.lit(mark))


def _synthesised(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("_tts"))


def subtitle_choice(files: DataFrame, original: bool, key: str = "folder", mark: str = ".bak.") -> DataFrame:
    """For each folder its subtitle file: an original or translated one if there is one, else any; the first by
    lower-cased name.  Backups never count."""
    rows = files.filter((_ext(F.col("name")) == ".vtt") & ~is_backup(F.col("name"), mark))
    wanted = F.contains(F.lower("name"), F.lit("_original")) == F.lit(original)
    return rows.groupBy(key).agg(F.min_by("name", F.struct((~wanted).alias("w"), F.lower("name").alias("l"), F.col("name").alias("n"))).alias("name"))


def video_choice(files: DataFrame, key: str = "folder") -> DataFrame:
    """For each folder the video that subtitles are made from: the first mp4, else the first other one, by lower-cased name
    as listings have it, and by name where that is equal.

    Synthesised videos are never chosen: a folder that has only these has no row.
    """
    ext = _ext(F.col("name"))
    rows = files.filter(ext.isin(VIDEO) & ~_synthesised(F.col("name")))
    return rows.groupBy(key).agg(F.min_by("name", F.struct((ext != ".mp4").alias("e"), F.lower("name").alias("l"), F.col("name").alias("n"))).alias("name"))


def reprocess_video(files: DataFrame, key: str = "folder") -> DataFrame:
    """For each folder the video to transcribe again: mp4 before others, by lower-cased name, whatever made it."""
    ext = _ext(F.col("name"))
    return files.filter(ext.isin(VIDEO)).groupBy(key).agg(F.min_by("name", F.struct((ext != ".mp4").alias("e"), F.lower("name").alias("l"), F.col("name").alias("n"))).alias("name"))


def folder_flags(files: DataFrame, key: str = "folder", transcripts: str = TRANSCRIPTS) -> DataFrame:
    """key with has_video, has_subtitles and has_output (a synthesised video): what eligibility is decided by.

    files: key, subfolder (null for files right in the folder), name.  Subtitles count only in the subfolder `transcripts`.
    """
    n, ext, direct = F.col("name"), _ext(F.col("name")), F.col("subfolder").isNull()
    return files.groupBy(key).agg(
        F.bool_or(direct & ext.isin(VIDEO)).alias("has_video"),
        F.bool_or(F.coalesce(F.col("subfolder") == transcripts, F.lit(False)) & (ext == ".vtt") & ~is_backup(n, ".bak")).alias("has_subtitles"),
        F.bool_or(direct & ext.isin(VIDEO) & _synthesised(n)).alias("has_output"),
    )


def eligible_folders(files: DataFrame, key: str = "folder", transcripts: str = TRANSCRIPTS) -> DataFrame:
    """Folders with a video, or with a transcript in their subfolder that is no backup, by lower-cased name."""
    flags = folder_flags(files.filter(F.col(key) != MANIFESTS), key, transcripts)
    return flags.filter("has_video or has_subtitles").select(key).orderBy(F.lower(key), key)


def normalised_tree(folders: DataFrame) -> DataFrame:
    """name, new_name, action of output folders: rename, unchanged, or skip where another folder has or gets that name first."""
    out = folders.select("name", normal_component(F.col("name")).alias("new_name"))
    w = Window.partitionBy("new_name")
    same = F.col("name") == F.col("new_name")
    out = out.withColumn("_taken", F.bool_or(same).over(w)).withColumn("_k", F.row_number().over(w.orderBy("name")))
    action = F.when(same, "unchanged").when(F.col("_taken") | (F.col("_k") > 1) | (F.col("new_name") == ""), "skip").otherwise("rename")
    return out.select("name", "new_name", action.alias("action"))


def patched(manifest: DataFrame, states: DataFrame) -> DataFrame:
    """manifest with the new states of its folders (output_folder, state) and changed: only those need to be written."""
    out = manifest.join(states.select("output_folder", F.col("state").alias("_new")), "output_folder", "left")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("state"))
    return out.withColumn("changed", changed).withColumn("state", F.coalesce("_new", "state")).drop("_new")
