"""Incremental work: resumption, registries, roll-ups, names that are still free, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import clean_name, safe_component
from .lineage import cut
from .running import before_blocks, blocks, in_block, met, stored

RESUMABLE = ["success", "already_current", "renamed_existing"]


def last_entries(manifest: DataFrame, statuses: list[str] = RESUMABLE) -> DataFrame:
    """The last entry of each source (by pos) among those with a usable status."""
    rows = manifest.filter(F.col("status").isin(statuses))
    return rows.groupBy("source").agg(F.max_by(F.struct(*[c for c in manifest.columns if c != "source"]), "pos").alias("_e")).select("source", "_e.*")


def resume_split(sources: DataFrame, manifest: DataFrame, artefacts: DataFrame | None = None) -> DataFrame:
    """sources with the entry that they resume from and resumed: their last usable entry, all of whose artefacts exist.

    artefacts: folder, name of what is stored; without it every entry counts as complete.
    """
    entry = last_entries(manifest)
    if artefacts is not None:
        need = entry.select("source", "output_folder", F.explode("required").alias("name"))
        missing = need.join(artefacts.select(F.col("folder").alias("output_folder"), "name"), ["output_folder", "name"], "left_anti")
        entry = entry.join(missing.select("source"), "source", "left_anti")
    kept = entry.select("source", F.col("output_folder"), F.lit(True).alias("_got"))
    return sources.join(kept, "source", "left").withColumn("resumed", F.coalesce("_got", F.lit(False))).drop("_got")


def first_duplicates(media: DataFrame, registry: DataFrame) -> DataFrame:
    """media with the first registry row (by pos) of the same hash that has an output folder."""
    first = registry.filter(F.coalesce("output_folder", F.lit("")) != "").groupBy("sha256").agg(F.min_by(F.struct("output_folder", "source", "pos"), "pos").alias("duplicate"))
    return media.join(first, "sha256", "left")


def unprocessed(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """Sources that no successful registry row names with their hash."""
    done = registry.filter("status = 'success'").select("name", "sha256").distinct()
    return sources.join(done, ["name", "sha256"], "left_anti")


def moved(rows: DataFrame, moves: DataFrame, column: str = "output_folder") -> DataFrame:
    """rows with renamed folders: column is looked up in moves (old, new)."""
    m = moves.select(F.col("old").alias(column), F.col("new").alias("_new"))
    return rows.join(m, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def matched_folders(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """For each source its output folder by the manifests: found, not_found or ambiguous."""
    have = manifest.filter(F.coalesce("output_folder", F.lit("")) != "").groupBy("source").agg(F.count_distinct("output_folder").alias("n"), F.min("output_folder").alias("output_folder"))
    out = wanted.join(have, "source", "left")
    n = F.coalesce("n", F.lit(0))
    kind = F.when(n == 0, "not_found").when(n == 1, "found").otherwise("ambiguous")
    return out.select(*wanted.columns, kind.alias("match"), F.when(n == 1, F.col("output_folder")).alias("output_folder"))


def counts(status: Column, wanted: list[str]) -> list[Column]:
    return [F.count_if(status == s).alias(f"n_{s}") for s in wanted]


def batch_status(status: Column) -> Column:
    """error if something failed and nothing succeeded; partial if something failed or is partial; else success."""
    failed, done, partial = F.count_if(status == "error"), F.count_if(status == "success"), F.count_if(status == "partial")
    return F.when((failed > 0) & (done == 0), "error").when((failed > 0) | (partial > 0), "partial").otherwise("success")


def archive_status(status: Column) -> Column:
    """partial if something failed or is translated in part; success if anything was processed; else error."""
    failed, partial = F.count_if(status == "error"), F.count_if(status == "partial_translation")
    return F.when((failed > 0) | (partial > 0), "partial").when(F.count_if(status.isNotNull()) > 0, "success").otherwise("error")


def raw_status(status: Column) -> Column:
    """error only if all failed; success even if some did."""
    failed = F.count_if(status == "error")
    return F.when((failed > 0) & (failed == F.count(status)), "error").otherwise("success")


def reprocess_status(status: Column) -> Column:
    failed, done, partial = F.count_if(status == "error"), F.count_if(status == "success"), F.count_if(status == "partial_translation")
    return F.when(failed > 0, F.when(done + partial > 0, "partial_failure").otherwise("error")).when(partial > 0, "partial_translation").otherwise("success")


def unique_stems(
    rows: DataFrame, taken: DataFrame | None = None, stem: str = "stem", order: str = "source", digest: str = "sha256", joint: str = "___", own: str | None = None, most: int | None = None
) -> DataFrame:
    """rows with output_stem, all different and none in taken (stem): by order, each takes the first that is free of its
    stem, the stem with three _ (or another joint) and the first 8 characters of its content's hash, and that with _02, _03
    and so on.  order must tell rows apart.  A null stem or hash is an empty one.

    most: stems are cleaned and fitted: a name has at most so many bytes, and its stem gives way to what follows it.
    own: a name in taken is free for the row whose column `own` has it.

    The rows of one stem and hash take the numbers that are free, one after the other: the kth of them gets the kth number
    that taken leaves free, which is k and as many more as there are taken ones before it.  So ranks among rows and
    ranks among taken numbers give all names at once, by sorts whose keys spread over tasks, however many names are taken.
    Only where a name can be read in two ways (a stem that ends like a numbered one) two rows may come to one name; then
    the first in order keeps it, the other's stem or number counts as taken, and all is ranked again - as often as such
    names meet in a chain.  With `own` a name may be free for one row alone: these rows ask round by round (_asked).
    """
    if own is not None:
        return _asked(rows, taken, stem, order, digest, joint, own)
    names = rows.columns
    text = F.coalesce(F.col(stem).cast("string"), F.lit(""))
    own_rows = rows.withColumn("_s", text).withColumn("_d", F.substring(F.coalesce(digest, F.lit("")), 1, 8))
    if most is not None:  # what a cut leaves of a stem is what it leaves of its longer cut, so stems that are cut alike are one
        own_rows = own_rows.withColumn("_s", clean_name(F.col("_s"))).withColumn("_s", F.coalesce(F.nullif(safe_component(_fitted("_s", F.lit(most))), F.lit("")), F.lit("_")))
    all_rows = stored(own_rows, "stems-rows")
    ranked = _rank(_rank(all_rows, ["_s"], [order], "_at"), ["_s", "_d"], [order], "_in")
    ranked = stored(ranked, "stems-ranked")
    families = stored(ranked.select("_s", "_d").distinct(), "stems-families")

    def with_name(df, n, out):
        number = F.when(n < 2, "").otherwise(F.concat(F.lit("_"), F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))))
        df = df.withColumn("_tail", F.concat(F.lit(joint), F.col("_d"), number))
        stem_of = F.col("_s") if most is None else _fitted("_s", F.lit(most) - F.octet_length("_tail"))
        whole = F.concat(stem_of, F.col("_tail"))
        return df.withColumn(out, F.when(n == 0, F.col("_s")).otherwise(whole if most is None else safe_component(whole))).drop("_tail")

    held = taken.select(F.col("stem").cast("string").alias("_name")).filter("_name is not null").distinct() if taken is not None else rows.sparkSession.createDataFrame([], "_name string")
    held = stored(held, "stems-taken")
    # a taken name as a stem, and as a number of a family: one name for each count of digits that a fitted one may have
    lost = stored(families.select("_s", F.col("_s").alias("_name")).distinct().join(held, "_name", "left_semi").select("_s"), "stems-lost")
    digits = F.regexp_extract("_name", "_([0-9]{2,9})$", 1)
    read = held.withColumn("_digits", F.length(digits)).withColumn("_n", F.when(digits == "", 1).otherwise(digits.try_cast("long")))
    plain = held.withColumn("_digits", F.lit(0)).withColumn("_n", F.lit(1).cast("long"))
    read = read.filter((F.col("_n") >= 2) & ((F.col("_digits") == 2) | (F.col("_n") >= F.pow(F.lit(10), F.col("_digits") - 1))))
    read = plain.unionByName(read).withColumn("_base", F.expr("if(_digits = 0, _name, left(_name, length(_name) - _digits - 1))")).drop("_name")
    kinds = F.array(*[F.struct(F.lit(d).alias("_digits"), F.lit(1 if d == 0 else 10 ** (d - 1) if d > 2 else 2).cast("long").alias("_k")) for d in (0, *range(2, 10))])
    bases = families.select("*", F.explode(kinds).alias("_v")).select("_s", "_d", "_v._digits", F.col("_v._k").alias("_k"))
    bases = with_name(bases, F.col("_k"), "_whole").withColumn("_base", F.expr("if(_digits = 0, _whole, left(_whole, length(_whole) - _digits - 1))"))
    blocked = stored(bases.select("_s", "_d", "_digits", "_base").join(read, ["_base", "_digits"]).select("_s", "_d", "_n").distinct(), "stems-blocked")

    while True:
        # the first of a stem has the stem itself, unless that is lost; the others of its family follow it from there
        gone = lost.withColumn("_lost", F.lit(True))
        first = (F.col("_at") == 1) & F.col("_lost").isNull()
        tops = ranked.filter("_at = 1").join(lost, "_s", "left_anti").select("_s", F.col("_d").alias("_top"))
        asked = ranked.join(gone, "_s", "left").join(tops, "_s", "left")
        place = F.col("_in") - F.when(F.coalesce(F.col("_top") == F.col("_d"), F.lit(False)), 1).otherwise(0)
        asked = stored(asked.withColumn("_k", F.when(first, 0).otherwise(place).cast("long")).drop("_lost", "_top"), "stems-asked")
        # v of the ith taken number is how many free ones come before it: the kth free number has those with v < k before it
        steps = _rank(blocked, ["_s", "_d"], ["_n"], "_i").select("_s", "_d", (F.col("_n") - F.col("_i")).alias("_k"), F.lit(0).alias("_side"), F.lit(None).cast(rows.schema[order].dataType).alias(order))
        asking = asked.filter("_k > 0").select("_s", "_d", "_k", F.lit(-1).alias("_side"), order)
        both = blocks(steps.unionByName(asking), ["_s", "_d"], ["_k", "_side", order], "stems-steps")
        one = F.when(F.col("_side") == 0, 1).otherwise(0)
        offsets = stored(before_blocks(both, ["_s", "_d"], one, "_before"), "stems-offsets")
        passed = met(both, offsets, ["_s", "_d", "block"], offsets.count()).withColumn("_passed", in_block(["_s", "_d"], ["_k", "_side", order], one) + F.col("_before"))
        number = passed.filter("_side = -1").select(order, (F.col("_k") + F.col("_passed")).alias("_n"))
        named = asked.join(number, order, "left").withColumn("_n", F.coalesce("_n", F.lit(0).cast("long")))
        named = stored(with_name(named, F.col("_n"), "output_stem"), "stems-named")
        met_twice = named.groupBy("output_stem").agg(F.min(order).alias("_first"), F.count("*").alias("_c")).filter("_c > 1")
        losers = stored(named.join(met_twice, "output_stem").filter(F.col(order) != F.col("_first")).select("_s", "_d", "_n"), "stems-losers")
        if losers.isEmpty():
            return named.select(*names, "output_stem")
        lost = stored(lost.unionByName(losers.filter("_n = 0").select("_s")).distinct(), "stems-lost")
        blocked = stored(blocked.unionByName(losers.filter("_n > 0")).distinct(), "stems-blocked")


def _fitted(c: str, budget: Column) -> Column:
    """A stem within budget bytes, whole characters of it; what is cut ends in no blank, dot, _ or -."""
    cut_bytes = F.substring(F.encode(F.col(c), "UTF-8"), F.lit(1), F.greatest(budget, F.lit(1)).cast("int")).cast("string")
    # half a character at the end becomes a replacement mark, and goes
    return F.when(F.octet_length(c) <= budget, F.col(c)).otherwise(F.regexp_replace(F.make_valid_utf8(cut_bytes), "[\ufffd ._-]+$", ""))


def _rank(rows: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """rows with their rank (long, from 1) among those of their key, a key's rows spread over blocks."""
    cut_rows = blocks(rows, keys, order, "ranks")
    one = F.lit(1)
    offsets = stored(before_blocks(cut_rows, keys, one, "_before"), "ranks-offsets")
    return met(cut_rows, offsets, [*keys, "block"], offsets.count()).withColumn(out, in_block(keys, order, one) + F.col("_before")).drop("block", "_before")


def _asked(rows: DataFrame, taken: DataFrame | None, stem: str, order: str, digest: str, joint: str, own: str | None) -> DataFrame:
    """unique_stems by asking: every row asks for its first choice; of those that ask for one name the first in order keeps it,
    the others ask for their next, until none has to."""
    by_stem, by_content = Window.partitionBy(stem).orderBy(order), Window.partitionBy(stem, F.substring(digest, 1, 8)).orderBy(order)
    first = F.when(F.row_number().over(by_stem) == 1, 0).otherwise(F.greatest(F.row_number().over(by_content) - 1, F.lit(1)))
    asking = rows.withColumn("_choice", first.cast("long"))
    own_stem = F.coalesce(F.col(stem).cast("string"), F.lit(""))
    hashed = F.concat(own_stem, F.lit(joint), F.substring(F.coalesce(digest, F.lit("")), 1, 8))
    name = F.when(F.col("_choice") == 0, own_stem).when(F.col("_choice") == 1, hashed).otherwise(F.concat(hashed, F.format_string("_%02d", "_choice")))
    held = None if taken is None else taken.select(F.col("stem").alias("output_stem")).distinct().withColumn("_held", F.lit(True))
    while True:
        asked = asking.withColumn("output_stem", name)
        asked = asked.withColumn("_held", F.lit(None).cast("boolean")) if held is None else asked.join(held, "output_stem", "left")
        others = F.col("_held").isNotNull() if own is None else F.col("_held").isNotNull() & ~F.coalesce(F.col("output_stem") == F.col(own), F.lit(False))
        asked = cut(asked.withColumn("_lost", others | (F.row_number().over(Window.partitionBy("output_stem").orderBy(order)) > 1)))
        if asked.filter("_lost").isEmpty():
            return asked.select(*rows.columns, "output_stem")
        asking = asked.withColumn("_choice", F.col("_choice") + F.col("_lost").cast("long")).select(*rows.columns, "_choice")


def renames(sources: DataFrame, manifest: DataFrame, folders: DataFrame) -> DataFrame:
    """What a run that only renames does with each source (source, desired): status, output_folder, old_folder.

    The source's last successful or renamed entry gives its folder.  Without an entry: not_found_in_previous_manifest; a
    folder that is not among folders (folder) has no status.  A folder that has its desired name is already_current; another
    is renamed_existing, to the desired name, or with _ and the first 8 characters of the old one where that is taken,
    numbered from _02.  What is taken is what was there at the start, and the names given by order of source.
    """
    entry = last_entries(manifest.select("source", "pos", "status", "output_folder"), ["success", "renamed_existing"])
    out = sources.join(entry.select("source", F.col("output_folder").alias("old_folder")), "source", "left")
    have = folders.select(F.col("folder").alias("old_folder"), F.lit(True).alias("_there")).distinct()
    out = out.join(have, "old_folder", "left")
    there, same = F.col("_there").isNotNull(), F.col("old_folder") == F.col("desired")
    status = F.when(F.col("old_folder").isNull(), "not_found_in_previous_manifest").when(there & same, "already_current").when(there, "renamed_existing")
    out = out.withColumn("status", status).drop("_there")
    moving = out.filter("status = 'renamed_existing'")
    named = unique_stems(moving.withColumn("_digest", F.when(F.col("old_folder") == "", "legacy").otherwise(F.col("old_folder"))), folders.select(F.col("folder").alias("stem")), "desired", "source", "_digest", "_", "old_folder")
    rest = out.filter("status is null or status <> 'renamed_existing'").withColumn("output_folder", F.when(F.col("status") == "already_current", F.col("old_folder")))
    return named.drop("_digest").withColumnRenamed("output_stem", "output_folder").unionByName(rest).select("source", "status", "old_folder", "output_folder")


#: Bytes of a file name, and the longest ending that a run gives to an output's stem.
MOST_NAME, LONGEST_ENDING = 255, "_original.vtt"


def planned(sources: DataFrame, manifest: DataFrame, registry: DataFrame, folders: DataFrame, artefacts: DataFrame | None = None, most: int = MOST_NAME - len(LONGEST_ENDING)) -> DataFrame:
    """What a run does with each source (source, sha256, desired): status and output_folder.

    Resumed sources, all of whose artefacts are there, stay (already_current) or are to be renamed (renamed_existing).  Of the
    others, those whose content the registry has are renamed_existing if its folder is still among folders (folder), else
    skipped_duplicate.  The rest is pending, each with a folder name of its own, cleaned and of at most `most` bytes, so that
    the names of its files fit too; where a hash or number tells names apart, it is the stem that gives way.
    """
    resumed = resume_split(sources, manifest, artefacts).withColumnRenamed("output_folder", "_own")
    known = first_duplicates(resumed, registry).join(folders.select(F.col("folder").alias("_folder"), F.lit(True).alias("_there")).distinct(), F.col("duplicate.output_folder") == F.col("_folder"), "left")
    folder = F.when(F.col("resumed"), F.col("_own")).when(F.col("_there"), F.col("_folder"))
    rows = known.select("source", "sha256", "desired", "resumed", F.col("duplicate").isNotNull().alias("duplicate"), folder.alias("folder"), F.lit(False).alias("failed"))
    rows = source_status(rows)
    new = unique_stems(rows.filter("status = 'success'"), folders.select(F.col("folder").alias("stem")), "desired", most=most)
    new = new.select("source", F.lit("pending").alias("status"), F.col("output_stem").alias("output_folder"))
    return new.unionByName(rows.filter("status <> 'success'").select("source", "status", F.col("folder").alias("output_folder")))


def within_limits(members: DataFrame, most_files: int, most_bytes: int, key: str = "archive") -> DataFrame:
    """members with running totals in archive order, and fault at each that exceeds a limit; the first one is what counts."""
    w = Window.partitionBy(key).orderBy("depth", "pos").rowsBetween(Window.unboundedPreceding, 0)
    out = members.withColumn("files", F.count("*").over(w)).withColumn("bytes", F.sum("size").over(w))
    return out.withColumn("fault", F.when(F.col("files") > most_files, "files").when(F.col("bytes") > most_bytes, "bytes"))


def collisions(members: DataFrame, path: Column, key: str = "archive") -> DataFrame:
    """members with collides: another member of the archive has the same folded path, before it."""
    rows = members.withColumn("_path", path)
    return rows.withColumn("collides", F.row_number().over(Window.partitionBy(key, "_path").orderBy("depth", "pos")) > 1).drop("_path")


def totals(members: DataFrame, key: str = "archive") -> DataFrame:
    return members.groupBy(key).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("depth").alias("depth"))


def source_status(rows: DataFrame) -> DataFrame:
    """rows (resumed, duplicate, folder, desired, failed) with status: what the run does with each source."""
    renamed = F.coalesce(F.col("folder") != F.col("desired"), F.lit(False))
    status = (
        F.when(F.col("resumed"), F.when(renamed, "renamed_existing").otherwise("already_current"))
        .when(F.col("duplicate"), F.when(F.col("folder").isNotNull(), "renamed_existing").otherwise("skipped_duplicate"))
        .when(F.col("failed"), "error")
        .otherwise("success")
    )
    return rows.withColumn("status", status)


def repair_action(original_ok: Column, translated_ok: Column, has_video: Column) -> Column:
    """What to do with an output's subtitles: a bad original takes a new transcription and translation."""
    return F.when(~has_video, "skipped").when(~original_ok, "transcribe_and_translate").when(~translated_ok, "translate").otherwise("valid")


def reprocess_action(mode: Column, has_original: Column, has_video: Column) -> Column:
    need_stt = mode.isin("stt_only", "full")
    return F.when(need_stt & ~has_video, "error").when((mode == "translate_only") & ~has_original, "error").when(mode.isin("stt_only", "translate_only", "full"), mode)


def synthesis_action(has_video: Column, repaired: Column, has_cues: Column, has_output: Column) -> Column:
    """Whether an output gets a voice: outputs that are there stay, whatever was repaired."""
    return F.when(~has_video, "no_video").when(~has_cues, "no_subtitles").when(has_output, "exists").when(~repaired, "not_repaired").otherwise("synthesize")
