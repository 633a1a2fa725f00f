"""Duplicate outputs: content signatures, conservative decisions, checked deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import stability
from ..functions.text import casefold


def signatures(files: DataFrame, skip: str = "_manifests") -> DataFrame:
    """folder, signature: the sorted hashes of a folder's files, names apart and copies kept; what is in `skip` does not count.

    files: folder, rel_path, content (binary or string).
    """
    kept = files.filter(F.split_part("rel_path", F.lit("/"), F.lit(1)) != skip)
    hashed = kept.select("folder", F.sha2(F.col("content").cast("binary"), 256).alias("h"))
    return hashed.groupBy("folder").agg(F.sort_array(F.collect_list("h")).alias("signature"))


def decisions(folders: DataFrame) -> DataFrame:
    """For each signature that several folders have: the folder to keep, and whether the others may go.

    folders: name, signature.  The most stable name leads, ties by folded name; the others may go only if it is strictly
    more stable than the runner-up, otherwise all stay.  Folders are read once and counted by signature and score before
    they are shuffled; a signature then has a row for each score, of which there are few, so no list of its folders is built.
    """
    rated = folders.withColumn("_s", stability(F.col("name"))["score"])
    order = F.struct((-F.col("_s")).alias("s"), casefold(F.col("name")).alias("n"), F.col("name").alias("name"))
    levels = rated.groupBy("signature", "_s").agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    out = levels.groupBy("signature").agg(
        F.sum("_n").alias("n_folders"),
        F.min("_first").alias("_first"),
        F.sort_array(F.collect_list(F.struct("_s", "_n")), asc=False).alias("_levels"),
    )
    score = F.col("_levels")[0]["_s"]
    second = F.when(F.col("_levels")[0]["_n"] > 1, score).otherwise(F.get("_levels", F.lit(1))["_s"])
    return out.filter("n_folders > 1").select(
        "signature",
        F.col("_first.name").alias("canonical"),
        "n_folders",
        score.alias("score"),
        second.alias("runner_up"),
        F.when(score > second, "delete_duplicates").otherwise("keep").alias("decision"),
    )


def plan(folders: DataFrame, decided: DataFrame) -> DataFrame:
    """canonical, duplicate, signature for every folder that may go."""
    go = decided.filter("decision = 'delete_duplicates'").select("signature", "canonical")
    return folders.select("signature", F.col("name").alias("duplicate")).join(go, "signature").filter("duplicate <> canonical")


def checked(plan: DataFrame, now: DataFrame) -> DataFrame:
    """plan with refusal: the first reason against each deletion by a fresh scan (name, signature); null if it may be done."""
    fresh = now.groupBy("name").agg(F.first("signature").alias("_s"))
    out = plan.join(fresh.select(F.col("name").alias("canonical"), F.col("_s").alias("_c")), "canonical", "left")
    out = out.join(fresh.select(F.col("name").alias("duplicate"), F.col("_s").alias("_d")), "duplicate", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    outside = lambda c: F.col(c).contains("/") | F.col(c).isin(".", "..")
    refusal = (
        F.when(blank("canonical") | blank("duplicate"), "invalid entry")
        .when(F.col("canonical") == F.col("duplicate"), "same folder")
        .when(outside("canonical") | outside("duplicate"), "outside the root")
        .when(F.col("_c").isNull(), "canonical is gone")
        .when(F.col("_d").isNull(), "duplicate is gone")
        .when(F.col("_c") != F.col("signature"), "canonical changed")
        .when(F.col("_d") != F.col("signature"), "duplicate changed")
    )
    return out.withColumn("refusal", refusal).drop("_c", "_d")


def removed(registry: DataFrame, gone: DataFrame, column: str = "output_folder") -> tuple[DataFrame, DataFrame]:
    """(what stays of the registry, the history of what went): rows of deleted folders (gone: name)."""
    names = gone.select(F.col("name").alias(column)).distinct()
    return registry.join(names, column, "left_anti"), registry.join(names, column, "left_semi")


def ranked(folders: DataFrame) -> DataFrame:
    """folders of one signature in order of preference, with the next one's score."""
    rated = folders.withColumn("score", stability(F.col("name"))["score"])
    w = Window.partitionBy("signature").orderBy(F.desc("score"), casefold(F.col("name")), "name")
    return rated.withColumn("rank", F.row_number().over(w)).withColumn("next_score", F.lead("score").over(w))
