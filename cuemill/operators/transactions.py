"""Changes to output folders that either take effect whole or leave what was there: replace, reprocess, regenerate, archive."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.outputs import Once, Outputs
from .listings import TRANSCRIPTS, VIDEO

# How far cues may be off, and what a plausible number of them is.
EPSILON, MOST_OVERLAP, MOST_CUES, MOST_GROWTH, GROWTH_SLACK = 0.001, 10.0, 100_000, 10, 100
MODES = ("stt_only", "translate_only", "full")


def isolated(rows: DataFrame, work: Callable[[dict], dict], result: str, once: Once | None = None, key: str = "folder") -> DataFrame:
    """rows with status, error_type, error and the columns of `result` (DDL) that work(row) gives; a row that raises is an
    error of its own, and the others stand.  A work's own "status" is kept; without one it is success.

    A plan may run more than once: for two actions, or where a task is tried again.  With `once`, work is done once for each
    value of `key` in that run, and every other time its outcome is read; its results are then to be what JSON holds.
    """
    own = T.StructType.fromDDL(result)
    names = rows.columns
    extra = [f for f in own.fields if f.name not in ("status", *names)]
    schema = T.StructType([*rows.schema.fields, T.StructField("status", T.StringType()), T.StructField("error_type", T.StringType()), T.StructField("error", T.StringType()), *extra])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def outcome(row: dict) -> dict:
        if once:
            return once.do(str(row[key]), lambda again: work(dict(row)) or {})
        try:
            return {"outcome": work(dict(row)) or {}}
        except Exception as e:  # whatever fails is this row's
            return {"error_type": type(e).__name__, "error": str(e)}

    def run(batches):
        for b in batches:
            out = []
            for row in b.to_pylist():
                told = outcome(row)
                if "outcome" in told:
                    got = told["outcome"]
                    out.append({**row, "status": got.get("status", "success"), **{f.name: got.get(f.name) for f in extra}})
                else:
                    out.append({**row, "status": "error", "error_type": told["error_type"], "error": told["error"]})
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in out], schema=arrow)

    return rows.mapInArrow(run, schema)


def faults(cues: list[dict], before: int = 0) -> list[str]:
    """Why cues (start, end, text) can't replace `before` earlier ones; none if they can."""
    out, start, end = [], -1.0, -1.0
    for k, c in enumerate(cues, 1):
        s, e = float(c["start"]), float(c["end"])
        if not 0 <= s <= e < float("inf"):
            out.append(f"cue {k}: invalid times")
        if s + EPSILON < start:
            out.append(f"cue {k}: out of order")
        if s + EPSILON < end and end - s > MOST_OVERLAP:
            out.append(f"cue {k}: overlap")
        start, end = s, e
    if not cues:
        out.append("no cues")
    if before and len(cues) > before * MOST_GROWTH + GROWTH_SLACK:
        out.append("implausibly many cues")
    if len(cues) > MOST_CUES:
        out.append("too many cues")
    return out


def backup_name(outputs: Outputs, folder: tuple[str, ...], name: str, stamp: str | None = None) -> str:
    """A free name for a copy: name.bak (or name.bak.<stamp>), then with .01, .02 and so on."""
    plain = f"{name}.bak.{stamp}" if stamp else f"{name}.bak"
    candidate, k = plain, 1
    while outputs.exists(*folder, candidate):
        candidate, k = f"{plain}.{k:02d}", k + 1
    return candidate


def replace(outputs: Outputs, folder: tuple[str, ...], name: str, data: bytes, stamp: str | None = None) -> str | None:
    """Writes name, after a copy of what it held; the copy's name, or null where nothing was there."""
    copy = None
    if outputs.exists(*folder, name):
        copy = backup_name(outputs, folder, name, stamp)
        outputs.copy((*folder, name), (*folder, copy))
    try:
        outputs.write(data, *folder, name)  # under its name only once it is whole
    except BaseException:
        if copy:
            outputs.delete(*folder, copy)
        raise
    return copy


def published(outputs: Outputs, files: list[tuple[tuple[str, ...], str, bytes]], stamp: str | None, record: Callable[[list[str]], None]) -> None:
    """Replaces files (folder, name, data) and then calls record(copies); if any of it fails, what was there before is there again."""
    done: list[tuple[tuple[str, ...], str, str | None]] = []
    try:
        for where, name, data in files:
            done.append((where, name, replace(outputs, where, name, data, stamp)))
        record([c for _, _, c in done if c])
    except BaseException:
        for where, name, copy in reversed(done):
            if copy:
                outputs.write(outputs.read(*where, copy), *where, name)
                outputs.delete(*where, copy)
            else:
                outputs.delete(*where, name)
        raise


def _first(names: Iterable[str], *tests) -> str | None:
    names = list(names)
    for test in tests:
        if hit := [n for n in names if test(n)]:
            return hit[0]
    return None


def _subtitles(names: list[str], mark: str) -> str | None:
    usable = [n for n in names if n.lower().endswith(".vtt") and ".bak" not in n.lower()]
    return _first(usable, lambda n: mark in n.lower(), lambda n: True)


def reprocess(
    outputs: Outputs,
    folder: str,
    mode: str,
    language: str,
    parse: Callable[[bytes], list[dict]],
    render: Callable[[list[dict]], bytes],
    transcribe: Callable[[str], list[dict]] | None = None,
    translate: Callable[[list[dict]], list[dict]] | None = None,
    video: str | None = None,
    stamp: str | None = None,
) -> dict:
    """Makes a folder's subtitles anew and publishes them only if all of them are valid; returns what its history records.

    stt_only: the original transcription from the video; translate_only: the translation from the original one; full: both.
    What is replaced stays beside it under a dated name.  A failure changes nothing: files that had been replaced by then are restored.
    """
    mode = mode.lower().replace("-", "_")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    stamp = stamp or datetime.now(UTC).strftime("%Y%m%dT%H%M%S%fZ")
    files, inner = outputs.names(folder), outputs.names(folder, TRANSCRIPTS)
    videos = [n for n in files if n.lower().endswith(tuple(VIDEO)) and video in (None, n)]
    video = _first(videos, lambda n: n.lower().endswith(".mp4"), lambda n: True)
    old, old_translated = _subtitles(inner, "_original"), _subtitles(files, f"_{language.lower()}")
    if mode != "translate_only" and video is None:
        raise FileNotFoundError(f"no video in {folder}")
    if mode == "translate_only" and old is None:
        raise FileNotFoundError(f"no original transcription in {folder}/{TRANSCRIPTS}")

    def checked(cues, before, what):
        if why := faults(cues, before):
            raise ValueError(f"{what}: {why}")
        return cues

    before = checked(parse(outputs.read(folder, TRANSCRIPTS, old)), 0, "existing transcription") if old else []
    stem = (video or old).rsplit(".", 1)[0].removesuffix("_original")
    cues, publish = before, []
    if mode != "translate_only":
        cues = checked(transcribe(outputs.at(folder, video)), len(before), "new transcription")
        publish.append(((folder, TRANSCRIPTS), old or f"{stem}_original.vtt", render(cues)))
    failed = 0
    if mode != "stt_only":
        had = len(before)
        if mode == "full":
            had = len(checked(parse(outputs.read(folder, old_translated)), 0, "existing translation")) if old_translated else len(cues)
        translated = checked(translate(cues), had, "new translation")
        failed = sum(bool(c.get("translation_failed")) for c in translated)
        publish.append(((folder,), old_translated or f"{stem}_{language.lower()}.vtt", render(translated)))
    result = {
        "operation": "reprocess_subtitles",
        "mode": mode,
        "status": "partial_translation" if failed else "success",
        "output_folder": folder,
        "video": video,
        "segments": len(cues),
        "translation_failed_segments": failed,
        "published": [name for _, name, _ in publish],
        "backups": [],
    }

    def record(copies):
        result["backups"] = copies
        outputs.write(json.dumps(result, ensure_ascii=False, indent=2).encode(), folder, "reprocess_history", f"reprocess_{stamp}.json")

    published(outputs, publish, stamp, record)
    return result


def reprocess_all(folders: DataFrame, outputs: Outputs, mode: str, language: str, run_id: str | None = None, **steps) -> DataFrame:
    """folders (folder) with what reprocess gives for each of them, side by side on the executors; a folder that fails stays as it was.

    A folder is made anew once in a run, however often the result is read or a task is tried; another call is another run,
    unless it is given the run_id of an earlier one, which it then resumes: what has an outcome there, an error too, keeps it.
    """
    result = "segments long, translation_failed_segments long, published array<string>, backups array<string>"
    return isolated(folders, lambda r: reprocess(outputs, r["folder"], mode, language, **steps), result, Once(outputs, run_id))


class RegenerationError(RuntimeError):
    """A regeneration that ended without success; what was there is back in place."""


def regenerate(outputs: Outputs, folders: Iterable[str], run_id: str, run: Callable[[], dict], keep: Iterable[str] = ()) -> dict:
    """Makes folders anew from nothing: each (the first of equal names, blank ones aside) moves to a backup, run() works,
    and on status success the backups go; otherwise, in reverse, they come back, and so do the files `keep` names
    (manifests) with the bytes they had."""
    held = {name: outputs.read(name) if outputs.exists(name) else None for name in keep}
    moved: list[tuple[str, str]] = []
    try:
        for folder in dict.fromkeys(f.strip() for f in folders if f and f.strip()):
            if outputs.exists(folder):
                copy = f".regeneration-backup-{run_id}-{folder}"
                outputs.move(folder, copy)
                moved.append((folder, copy))
        result = run()
        if result.get("status") != "success":
            raise RegenerationError(f"ended with status {result.get('status')!r}")
    except BaseException:
        for folder, copy in reversed(moved):
            outputs.delete(folder)
            outputs.move(copy, folder)
        for name, data in held.items():
            outputs.delete(name) if data is None else outputs.write(data, name)
        raise
    for _, copy in moved:
        outputs.delete(copy)
    return {"status": "success", "run_id": run_id, "folders": [f for f, _ in moved], "result": result}


def finalized(sources: DataFrame, outputs: Outputs, archive: str = "archive/sources", run_id: str | None = None) -> DataFrame:
    """sources (name, run status) that succeeded, with sha256, size and archive_name: copied, checked, ready to be registered.

    A copy whose checksum differs is deleted and is the row's error.  A source that is gone already has status absent.
    The row is to be appended to the registry (append_json_lines) before removed() deletes sources.  Each source is archived
    once in a run: read again after removed(), the rows still tell what was archived.
    """

    def work(row):
        name = row["name"]
        if not outputs.exists(name):
            return {"status": "absent"}
        sha, size = outputs.fingerprint(name)
        base = name.rsplit("/", 1)[-1]
        stem, dot, suffix = base.rpartition(".")
        tail = f"__{sha[:16]}" + (f".{suffix.lower()}" if dot and stem else "")
        kept = (stem if dot and stem else base).encode()[: 255 - len(tail.encode())].decode(errors="ignore")
        target = f"{archive}/{kept}{tail}"
        outputs.copy((name,), (target,))
        if outputs.fingerprint(target)[0] != sha:
            outputs.delete(target)
            raise OSError("the archived copy differs from its source")
        return {"sha256": sha, "size": size, "archive_name": f"{kept}{tail}"}

    return isolated(sources.filter("status = 'success'").drop("status"), work, "sha256 string, size long, archive_name string", Once(outputs, run_id, ("_manifests", "runs", "archived")), "name")


def removed(registered: DataFrame, outputs: Outputs, run_id: str | None = None) -> DataFrame:
    """registered (name, sha256) sources deleted, if they still are what was archived; status removed, changed or absent, as the
    first reading of this run found it."""

    def work(row):
        if not outputs.exists(row["name"]):
            return {"status": "absent"}
        if outputs.fingerprint(row["name"])[0] != row["sha256"]:
            return {"status": "changed"}
        outputs.delete(row["name"])
        return {"status": "removed"}

    return isolated(registered.select("name", "sha256"), work, "status string", Once(outputs, run_id, ("_manifests", "runs", "removed")), "name")


def raw_videos(files: DataFrame, work: Callable[[dict], dict], once: Once | None = None) -> DataFrame:
    """files (name) of a folder without archives that are videos, with output_folder (the stem of the name) and the outcome of
    work: status success, partial_translation or error, each its own.  raw_status rolls them up.  With once, work is done once
    for each name of a run."""
    from ..functions.names import course_lesson
    from ..functions.uris import RAW_MEDIA, media_class

    rows = files.filter(media_class(F.col("name"), RAW_MEDIA) == "media").withColumn("output_folder", course_lesson(F.col("name"))["output_stem"])
    return isolated(rows, work, "segments long, translation_failed_segments long", once, "name")
