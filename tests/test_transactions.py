"""Transactions over output folders: what fails leaves what was there."""

import json
import os
import threading
import time
from collections import Counter

import pytest

from cuemill.operators import transactions as tx
from cuemill.sources.outputs import Once, Outputs

CUES = [{"start": 0.0, "end": 1.0, "text": "a"}, {"start": 1.0, "end": 2.0, "text": "b"}]
BAD = [{"start": 5.0, "end": 2.0, "text": "bad"}]
STEPS = {"parse": json.loads, "render": lambda cues: json.dumps(cues).encode()}


@pytest.fixture
def outputs(tmp_path):
    out = Outputs(str(tmp_path))
    for folder in ("f1", "f2"):
        out.write(b"video", folder, "v.mp4")
        out.write(json.dumps(CUES).encode(), folder, "original_transcriptions", "v_original.vtt")
        out.write(json.dumps(CUES).encode(), folder, "v_en.vtt")
    return out


def tree(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in path.rglob("*") if p.is_file()}


def test_faults():
    assert tx.faults(CUES) == [] and tx.faults([]) == ["no cues"] and tx.faults(BAD)
    assert tx.faults([{"start": 0, "end": 20, "text": ""}, {"start": 5, "end": 6, "text": ""}]) == ["cue 2: overlap"]
    assert tx.faults([{"start": 3, "end": 4, "text": ""}, {"start": 1, "end": 2, "text": ""}]) == ["cue 2: out of order"]
    many = [{"start": k, "end": k + 1, "text": ""} for k in range(111)]
    assert tx.faults(many, 1) == ["implausibly many cues"] and tx.faults(many, 2) == []


def test_reprocess_keeps_what_it_replaces(outputs, tmp_path):
    for k in range(2):
        got = tx.reprocess(outputs, "f1", "stt-only", "en", transcribe=lambda path: CUES, stamp="T", **STEPS)
        assert got["status"] == "success" and got["backups"] == ["v_original.vtt.bak.T" + (".01" if k else "")]
    assert len(list((tmp_path / "f1" / "reprocess_history").iterdir())) == 1
    failing = [{**c, "translation_failed": k == 0} for k, c in enumerate(CUES)]
    got = tx.reprocess(outputs, "f1", "full", "EN", transcribe=lambda path: CUES, translate=lambda cues: failing, **STEPS)
    assert got["status"] == "partial_translation" and got["published"] == ["v_original.vtt", "v_en.vtt"] and len(got["backups"]) == 2
    outputs.delete("f2", "v_en.vtt")
    got = tx.reprocess(outputs, "f2", "translate_only", "es", translate=lambda cues: cues, **STEPS)
    assert got["published"] == ["v_es.vtt"] and got["backups"] == [] and outputs.exists("f2", "v_es.vtt")


@pytest.mark.parametrize(
    "mode, steps",
    [("stt_only", {"transcribe": lambda p: BAD}), ("full", {"transcribe": lambda p: CUES, "translate": lambda c: BAD}), ("translate_only", {"translate": lambda c: []}), ("none", {}), ("full", {"transcribe": lambda p: 1 / 0})],
)
def test_invalid_subtitles_replace_nothing(outputs, tmp_path, mode, steps):
    before = tree(tmp_path)
    with pytest.raises((ValueError, ZeroDivisionError)):
        tx.reprocess(outputs, "f1", mode, "en", **steps, **STEPS)
    assert tree(tmp_path) == before


def test_reprocess_all_isolates_folders(spark, outputs, tmp_path):
    outputs.write(b"[]", "f3", "original_transcriptions", "x_original.vtt")
    outputs.write(b"video", "f3", "x.mp4")

    def transcribe(path):
        return CUES if "/f1/" in path else BAD

    folders = spark.createDataFrame([("f1",), ("f2",), ("f3",), ("f4",)], "folder string")
    got = {r.folder: (r.status, r.error_type, r.segments) for r in tx.reprocess_all(folders, outputs, "stt_only", "en", transcribe=transcribe, **STEPS).collect()}
    assert got == {"f1": ("success", None, 2), "f2": ("error", "ValueError", None), "f3": ("error", "ValueError", None), "f4": ("error", "FileNotFoundError", None)}


def test_regeneration(outputs, tmp_path):
    outputs.write(b"{}", "m.json")
    before = tree(tmp_path)

    def failing():
        outputs.write(b"half", "f1", "v.mp4")
        outputs.write(b"[]", "m.json")
        outputs.write(b"new", "n.json")
        return {"status": "error"}

    with pytest.raises(tx.RegenerationError):
        tx.regenerate(outputs, ["f1", " ", "f1", "f2", "gone"], "r", failing, ["m.json", "n.json"])
    assert tree(tmp_path) == before
    with pytest.raises(ZeroDivisionError):
        tx.regenerate(outputs, ["f1"], "r", lambda: 1 / 0)
    assert tree(tmp_path) == before

    def working():
        outputs.write(b"new", "f1", "v.mp4")
        return {"status": "success"}

    got = tx.regenerate(outputs, ["f1", "f1"], "r", working)
    assert got["folders"] == ["f1"] and (tmp_path / "f1" / "v.mp4").read_bytes() == b"new"
    assert not (tmp_path / "f1" / "v_en.vtt").exists() and not list(tmp_path.glob(".regeneration-backup-*"))


def test_sources_are_archived_checked_and_removed(spark, outputs, tmp_path, monkeypatch):
    for n in ("in/a.ZIP", "in/b.zip"):
        outputs.write(n.encode(), *n.split("/"))
    sources = spark.createDataFrame([("in/a.ZIP", "success"), ("in/b.zip", "error"), ("in/c.zip", "success")], "name string, status string")
    done = tx.finalized(sources, outputs)
    got = {r.name: (r.status, r["size"], r.archive_name) for r in done.collect()}
    sha = outputs.fingerprint("in", "a.ZIP")[0]
    assert got == {"in/a.ZIP": ("success", 8, f"a__{sha[:16]}.zip"), "in/c.zip": ("absent", None, None)}
    assert outputs.read("archive", "sources", f"a__{sha[:16]}.zip") == b"in/a.ZIP"
    again = {r.name: r.status for r in tx.finalized(sources, outputs).collect()}  # idempotent
    assert again == {"in/a.ZIP": "success", "in/c.zip": "absent"}
    registered = spark.createDataFrame([("in/a.ZIP", sha), ("in/b.zip", "other"), ("in/c.zip", "x")], "name string, sha256 string")
    assert {r.name: r.status for r in tx.removed(registered, outputs).collect()} == {"in/a.ZIP": "removed", "in/b.zip": "changed", "in/c.zip": "absent"}
    assert not (tmp_path / "in" / "a.ZIP").exists() and (tmp_path / "in" / "b.zip").exists()


def test_raw_videos(spark):
    files = spark.createDataFrame([("07 Forma.MP4",), ("x.m4v",), ("note.txt",), ("s.mp3",)], "name string")

    def work(row):
        if row["name"] == "x.m4v":
            raise RuntimeError("no segments")
        return {"status": "partial_translation", "segments": 3, "translation_failed_segments": 1}

    got = {r.name: (r.output_folder, r.status, r.segments) for r in tx.raw_videos(files, work).collect()}
    assert got == {"07 Forma.MP4": ("07_forma", "partial_translation", 3), "x.m4v": ("x_m4v", "error", None)}


def test_one_run_at_a_time(outputs):
    with outputs.lock("run.lock"):
        with pytest.raises(RuntimeError, match="another run"), outputs.lock("run.lock"):
            pass
    with outputs.lock("run.lock"), outputs.lock("run.lock", stale_seconds=-1):
        pass
    assert not outputs.exists("run.lock")


def test_an_overtaken_run_leaves_its_successors_lock(outputs):
    a, b = outputs.lock("run.lock"), outputs.lock("run.lock", stale_seconds=-1)
    a.__enter__()
    b.__enter__()
    a.__exit__()
    with pytest.raises(RuntimeError, match="another run"), outputs.lock("run.lock"):
        pass
    b.__exit__()
    assert not [n for n in outputs.names() if n.startswith("run.lock")]


def test_a_stale_lock_has_one_successor(outputs):
    outputs.write(json.dumps({"token": "old", "started_at": 0}).encode(), "run.lock")
    won, start = [], threading.Barrier(8)

    def run():
        start.wait()
        try:
            with outputs.lock("run.lock"):
                won.append(1)
                time.sleep(0.3)
        except RuntimeError:
            pass

    threads = [threading.Thread(target=run) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and not outputs.exists("run.lock")
    outputs.write(b"{not whole", "run.lock")  # a lock that tells nothing counts from when it was written
    with pytest.raises(RuntimeError, match="another run"), outputs.lock("run.lock"):
        pass
    os.utime(outputs.at("run.lock"), (0, 0))
    with outputs.lock("run.lock"):
        pass


def marks(path):
    return Counter(p.name.split("-")[0] for p in path.iterdir())


def test_work_is_done_once_for_two_actions(spark, outputs, tmp_path_factory):
    calls = tmp_path_factory.mktemp("calls")

    def transcribe(path):
        (calls / f"{path.split('/')[-2]}-{time.time_ns()}").write_text("")
        if "f2" in path:
            raise ValueError("no speech")
        return CUES

    folders = spark.createDataFrame([("f1",), ("f2",), ("f1",)], "folder string").repartition(3)
    done = tx.reprocess_all(folders, outputs, "stt_only", "en", transcribe=transcribe, **STEPS)
    first = sorted(map(str, done.collect()))
    assert done.count() == 3 and sorted(map(str, done.collect())) == first
    assert marks(calls) == {"f1": 1, "f2": 1}
    assert len([n for n in outputs.names("f1", "original_transcriptions") if ".bak" in n]) == 1 and len(outputs.names("f1", "reprocess_history")) == 1
    tx.reprocess_all(folders, outputs, "stt_only", "en", transcribe=transcribe, **STEPS).collect()  # another run
    assert marks(calls) == {"f1": 2, "f2": 2}
    for _ in range(2):  # one run, resumed
        tx.reprocess_all(folders, outputs, "stt_only", "en", run_id="r", transcribe=transcribe, **STEPS).collect()
    assert marks(calls) == {"f1": 3, "f2": 3}


def test_a_retried_task_has_one_effect(spark, outputs, tmp_path_factory):
    """A task that fails after its work was done is tried again: the work is not."""
    calls = tmp_path_factory.mktemp("calls")
    once = Once(outputs, "retried")

    def work(row):
        (calls / f"w-{time.time_ns()}").write_text("")
        return {"segments": 7}

    def after(batches):
        rows = list(batches)
        if not (calls / "failed-1").exists():
            (calls / "failed-1").write_text("")
            raise OSError("the executor is gone")
        yield from rows

    plan = tx.isolated(spark.createDataFrame([("f1",)], "folder string"), work, "segments long", once)
    for _ in range(2):
        try:
            got = plan.mapInArrow(after, plan.schema).collect()
        except Exception as e:
            assert "the executor is gone" in str(e)
    assert [(r.status, r.segments) for r in got] == [("success", 7)] and marks(calls)["w"] == 1


def test_those_who_come_meanwhile_wait(outputs):
    done, seen = [], []

    def work(again):
        done.append(again)
        time.sleep(1.5)  # longer than the lease: the claim is kept alive
        return {"n": len(done)}

    threads = [threading.Thread(target=lambda: seen.append(Once(outputs, "r", lease_seconds=0.8).do("k", work))) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert done == [False] and seen == [{"outcome": {"n": 1}}] * 4


def test_a_claim_that_died_has_one_successor(outputs):
    once = Once(outputs, "r", lease_seconds=0.5)
    claim = once._at("k", "claim0")
    outputs.create(b"dead", *claim)
    os.utime(outputs.at(*claim), (0, 0))
    done = []
    threads = [threading.Thread(target=lambda: once.do("k", lambda again: done.append(again) or {})) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert done == [True]


def test_archived_sources_tell_the_same_after_their_removal(spark, outputs):
    outputs.write(b"zip", "in", "a.zip")
    done = tx.finalized(spark.createDataFrame([("in/a.zip", "success")], "name string, status string"), outputs)
    first = [r.asDict() for r in done.collect()]
    gone = tx.removed(done.select("name", "sha256"), outputs)
    assert [r.status for r in gone.collect()] == ["removed"] and [r.status for r in gone.collect()] == ["removed"]
    assert [r.asDict() for r in done.collect()] == first and first[0]["status"] == "success"


def test_two_files_are_published_as_one(outputs, tmp_path, monkeypatch):
    before = tree(tmp_path)
    write = Outputs.write

    for broken in ("v_en.vtt", "reprocess_T.json"):

        def failing(self, data, *parts, broken=broken):
            if parts[-1] == broken and not failing.done:
                failing.done = True
                raise OSError("disk full")
            return write(self, data, *parts)

        failing.done = False
        monkeypatch.setattr(Outputs, "write", failing)
        with pytest.raises(OSError, match="disk full"):
            tx.reprocess(outputs, "f1", "full", "en", transcribe=lambda p: CUES[:1], translate=lambda c: c, stamp="T", **STEPS)
        assert tree(tmp_path) == before
