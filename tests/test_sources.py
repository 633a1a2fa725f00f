"""Readers and writers, and polling."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from cuemill.sources import documents, storage, vtt
from cuemill.streaming import polling
from cuemill.streaming.stages import Cancelled, Stages


def test_vtt(spark, tmp_path):
    (tmp_path / "a.vtt").write_text("\ufeffWEBVTT\r\n\r\nNOTE hi\r\n\r\n1\r\n00:00:01.000 --> 00:00:02,500 align:left\r\nOne\r\n two\r\n\r\n00:03.000 --> 00:04.000\r\nThree\r\n")
    got = [(r["index"], r.start, r.end, r.text) for r in vtt.read(spark, str(tmp_path), squeeze=True).orderBy("index").collect()]
    assert got == [(1, 1.0, 2.5, "One two"), (2, 3.0, 4.0, "Three")]
    cues = spark.createDataFrame([(1, 1, 0.0, 1.0, "a"), (1, 2, 59.9996, 61.0, "b")], "media_id int, seq int, start double, end double, text string")
    vtt.write(cues, str(tmp_path / "out"))
    back = vtt.read(spark, str(tmp_path / "out" / "*"))
    assert [(r.start, r.text) for r in back.orderBy("index").collect()] == [(0.0, "a"), (60.0, "b")]
    assert vtt.faults(cues.select("media_id").distinct(), cues.limit(0), "media_id").count() == 1


def test_json_lines_skip_what_is_broken(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"status": "success", "size": 3}\n\nnot json\n[1, 2]\n{"status": "error", "size": "x"}\n')
    got = [(r.status, r["size"]) for r in documents.json_lines(spark, str(p), "status string, size long").orderBy("pos").collect()]
    assert got == [("success", 3), ("error", None)]
    assert documents.successes(documents.json_lines(spark, str(p), "status string")).count() == 1


def test_manifest_versions(spark, tmp_path):
    (tmp_path / "new.json").write_text(json.dumps({"version": 2, "entries": [{"source": "a", "status": "success"}]}))
    (tmp_path / "old.json").write_text(json.dumps([{"source": "b"}, {"source": "c"}]))
    (tmp_path / "bad.json").write_text("{")
    read = lambda n: [(r.version, r.pos, r.source) for r in documents.manifest(spark, str(tmp_path / n)).collect()]
    assert read("new.json") == [(2, 0, "a")] and read("old.json") == [(1, 0, "b"), (1, 1, "c")]
    for n, v in (("none.json", {"entries": [{"source": "a"}]}), ("zero.json", {"version": 0, "entries": [{"source": "a"}]})):
        (tmp_path / n).write_text(json.dumps(v))
        assert read(n) == [(1, 0, "a")]
    assert read("absent.json") == []
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read("bad.json")


def test_publish(spark, tmp_path):
    path = str(tmp_path / "m.json")
    documents.write_json_document(spark, '{"a": 1}', path)
    documents.write_json_document(spark, '{"a": 2}', path)
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": 2} and not list(tmp_path.glob("*.part"))


def test_texts(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes("\ufeffhello  \n there".encode())
    (tmp_path / "c.csv").write_text('a, "b,c" ,\n,d,e\n')
    (tmp_path / "e.txt").write_bytes(b"")
    (tmp_path / "l.txt").write_bytes(b"\xff\xfe")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>One &amp;</w:t><w:t xml:space='preserve'> two</w:t></w:p>")
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", "<!DOCTYPE x [<!ENTITY a 'b'>]><w:t>One</w:t>")
    assert documents.text_file(spark, str(tmp_path / "t.txt")).first().text == "hello  \n there"
    for bad in ("e.txt", "l.txt"):
        with pytest.raises(Exception, match="empty file|not UTF-8"):
            documents.text_file(spark, str(tmp_path / bad)).collect()
    assert documents.csv_text(spark, str(tmp_path / "c.csv")).first().text.endswith("d, e")
    got = {os.path.basename(r.path): (r.text, r.error) for r in documents.docx_text(spark.read.format("binaryFile").load(str(tmp_path / "*.docx"))).collect()}
    assert got == {"d.docx": ("One & two", None), "x.docx": (None, "entities")}
    assert documents.prompt(spark, None, [str(tmp_path / "none.txt"), str(tmp_path / "t.txt")]) == "hello there"
    assert documents.prompt(spark, " a  b ", []) == "a b"
    (tmp_path / "big.txt").write_text("x" * (documents.PROMPT_BYTES + 1))
    with pytest.raises(ValueError, match="exceeds"):
        documents.prompt(spark, None, [str(tmp_path / "big.txt")])


def test_a_poll_opens_only_what_is_new(spark, tmp_path):
    import os
    import time

    box, registry = tmp_path / "in", str(tmp_path / "registry")
    box.mkdir()
    old = time.time() - 9000
    for name in ("a.zip", "b.zip", "notes.txt"):
        (box / name).write_bytes(name.encode())
        os.utime(box / name, (old, old))
    done = lambda rows: rows.withColumn("status", F.lit("success"))
    assert {r.name for r in polling.poll(spark, str(box), registry, done, 60).collect()} == {"a.zip", "b.zip"}
    # the same path, size and time: not opened, so other bytes are not seen; a touched file is opened, and is not new
    (box / "a.zip").write_bytes(b"A.zip")
    os.utime(box / "a.zip", (old, old))
    os.utime(box / "b.zip", (old + 5, old + 5))
    (box / "c.zip").write_bytes(b"c")
    os.utime(box / "c.zip", (old, old))
    assert [r.name for r in polling.poll(spark, str(box), registry, done, 60).collect()] == ["c.zip"]
    (box / "b.zip").write_bytes(b"new content")
    os.utime(box / "b.zip", (old + 9, old + 9))
    assert [(r.name, r.size) for r in polling.poll(spark, str(box), registry, done, 60).collect()] == [("b.zip", 11)]


def test_listing_and_polling(spark, tmp_path):
    box = tmp_path / "in"
    (box / "sub").mkdir(parents=True)
    for n, data in (("b.zip", b"1"), ("sub/a.ZIP", b"2"), ("c.txt", b"3")):
        (box / n).write_bytes(data)
    os.utime(box / "b.zip", (1, 1))
    assert [r.name for r in storage.zip_files(spark, str(box), 0).collect()] == ["b.zip", "a.ZIP"]
    assert [r.name for r in storage.zip_files(spark, str(box), 3600).collect()] == ["b.zip"]
    assert [r.name for r in storage.children(spark, str(box)).collect()] == ["b.zip", "c.txt"]
    registry = str(tmp_path / "registry")
    done = lambda d: d.withColumn("status", F.lit("success"))
    assert [r.name for r in polling.poll(spark, str(box), registry, done, 3600).collect()] == ["b.zip"]
    assert polling.poll(spark, str(box), registry, done, 3600).count() == 0
    os.utime(box / "sub/a.ZIP", (1, 1))
    assert [r.name for r in polling.poll(spark, str(box), registry, done, 3600).collect()] == ["a.ZIP"]
    with pytest.raises(ValueError):
        storage.Providers().read(spark, "ftp://x")
    assert storage.Providers().read(spark, f"local://{box}").count() == 3


def test_storage_rules(spark):
    files = spark.createDataFrame([("old", "old_a.vtt"), ("x", "y.mp4")], "folder string, name string")
    moves = spark.createDataFrame([("old", "new")], "old string, new string")
    assert {tuple(r) for r in storage.renamed(files, moves).select("folder", "name").collect()} == {("new", "new_a.vtt"), ("x", "y.mp4")}
    have = spark.createDataFrame([("new", "new_a.vtt")], "folder string, name string")
    assert [r.name for r in storage.missing_artefacts(have.union(spark.createDataFrame([("new", "b")], have.schema)), have).collect()] == ["b"]
    assert storage.remapped(spark.createDataFrame([("/in/a",), ("/out/b",)], "path string"), "/in", "/user").collect()[0].path == "/user/a"


def test_broken_models(spark):
    want = [("w.bin", 3, "h", None, None), ("c.json", None, None, 40, ["eos"])]
    expected = spark.createDataFrame([(m, k, *w) for m in "abcdefghi" for k, w in enumerate(want)], "model string, pos int, name string, size long, sha256 string, most_size long, json_keys array<string>")
    files = {
        "a": (("w.bin", 3, "h", False, None), ("c.json", 9, "", False, b'{"eos": 1}')),
        "b": (("w.bin", 4, "h", False, None), ("c.json", 9, "", True, b"{")),
        "c": (("w.bin", 4, "h", True, None),),
        "d": (("w.bin", 3, "x", False, None), ("c.json", 9, "", True, b"{")),
        "e": (("w.bin", 3, "h", False, None), ("c.json", 9, "", False, b'{"eos"')),
        "f": (("w.bin", 3, "h", False, None), ("c.json", 9, "", False, b"[1]")),
        "g": (("w.bin", 3, "h", False, None), ("c.json", 9, "", False, b'{"bos": 1}')),
        "h": (("w.bin", 3, "h", False, None), ("c.json", 41, "", False, b"{}")),
        "i": (("w.bin", 3, "h", True, None), ("c.json", 9, "", False, b"\xff")),
    }
    have = spark.createDataFrame([(m, *f) for m, fs in files.items() for f in fs], "model string, name string, size long, sha256 string, is_symlink boolean, content binary")
    got = {r.model: (r.fault, r.name) for r in storage.broken_models(expected, have).collect()}
    assert got == {"a": (None, None), "b": ("size", "w.bin"), "c": ("missing", "c.json"), "d": ("checksum", "w.bin"), "e": ("json", "c.json"), "f": ("object", "c.json"), "g": ("keys", "c.json"), "h": ("size", "c.json"), "i": ("symlink", "w.bin")}
    assert {r.model: r.fault for r in storage.broken_models(expected, have, 11).collect()}["a"] == "budget"


def test_listing_source(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for n in ("x.vtt", "a/y.vtt", "a/b/z.vtt", "a/n.txt"):
        (tmp_path / n).write_text("12")
    storage.register_listing(spark)
    got = spark.read.format("cuemill_listing").option("root", str(tmp_path)).option("pattern", "*.vtt").load()
    assert sorted((r.name, r.parent.rsplit("/", 1)[-1], r["size"]) for r in got.collect()) == [("x.vtt", tmp_path.name, 2), ("y.vtt", "a", 2), ("z.vtt", "b", 2)]


def test_stream(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.json").write_text('{"provider": "p", "ts": "2024-01-01T10:00:00Z", "amount": 2}\n{"provider": "p", "ts": "2024-01-01T20:00:00Z", "amount": 3}\n')
    seen = []
    q = polling.stream(spark, str(tmp_path / "src"), "provider string, ts timestamp, amount long", lambda df, _: seen.extend(polling.quota_windows(df).collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [(r.provider, r.used) for r in seen] == [("p", 5)]


def test_stages_tell_and_stop(spark, tmp_path):
    events = []
    stages = Stages(events.append)
    out = stages.run(spark.range(3), [("converting", lambda d: d.filter("id > 0")), ("translating", lambda d: d.filter("id > 1"))])
    assert [r.id for r in out.collect()] == [2]
    assert [(e["stage"], e["percent"], e["completed"], e["total"]) for e in events] == [("converting", 10, 0, 2), ("translating", 65, 1, 2)]

    def cancelling(d):
        stages.cancel.set()
        return d

    with pytest.raises(Cancelled):
        stages.run(spark.range(3), [("converting", cancelling), ("translating", lambda d: 1 / 0)])
    assert events[-1]["stage"] == "cancelled" and events[-1]["completed"] == 1

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.json").write_text('{"provider": "p"}\n')
    seen, live = [], Stages(events.append)
    start = lambda every=None: polling.stream(spark, str(tmp_path / "src"), "provider string", live.batches(lambda d, _: seen.extend(d.collect())), str(tmp_path / "cp"), every)
    assert live.watch(start()) and len(seen) == 1 and live.completed == 1
    query = start("1 second")
    live.cancel.set()
    assert not live.watch(query) and not query.isActive and events[-1]["stage"] == "cancelled"
