"""The drop folder as a stream source, paged listings, and publication in one step."""

import hashlib
import json
import os
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cuemill.sources import drop, paged, publish


def put(root, name, data, age):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    at = time.time() - age
    os.utime(path, (at, at))
    return path


def run(spark, root, out, check, **options):
    drop.register(spark)
    files = spark.readStream.format("cuemill_drop").option("root", str(root)).options(**options).load()
    q = files.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return Counter((r.name, r.sha256, r.error) for r in spark.read.schema(drop.SCHEMA).parquet(str(out)).collect())


def test_drop_folder_takes_each_settled_file_once(spark, tmp_path):
    root, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    sha = lambda b: hashlib.sha256(b).hexdigest()
    put(root, "a.zip", b"a" * 10, 300)
    put(root, "deep/B.ZIP", b"b", 300)
    put(root, "notes.txt", b"no archive", 300)
    young = put(root, "young.zip", b"half", 5)
    got = run(spark, root, out, check)
    assert got == {("a.zip", sha(b"a" * 10), None): 1, ("B.ZIP", sha(b"b"), None): 1}
    # what was taken is never opened again, and a restart repeats nothing
    (root / "a.zip").unlink()
    old = (root / "deep/B.ZIP").stat().st_mtime_ns
    (root / "deep/B.ZIP").write_bytes(b"written over, but with its old time")
    os.utime(root / "deep/B.ZIP", ns=(old, old))
    assert run(spark, root, out, check) == got
    # the young file settles later, is written over and settles again; an older one that was put there meanwhile too
    put(root, "young.zip", b"whole", 100)
    put(root, "c.zip", b"c", 200)
    got = run(spark, root, out, check)
    assert got[("young.zip", sha(b"whole"), None)] == 1 and got[("c.zip", sha(b"c"), None)] == 1 and len(got) == 4
    os.utime(young, (time.time() - 80, time.time() - 80))  # touched: a new state of the file
    assert run(spark, root, out, check)[("young.zip", sha(b"whole"), None)] == 2


def test_drop_folder_deals_files_by_size(tmp_path):
    for k in range(6):
        put(tmp_path, f"{k}.zip", b"x" * 40, 100 - k)
    reader = drop.DropReader(str(tmp_path), "*.zip", 10, 100, True)
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [len(p.value) for p in parts] == [2, 2, 2]
    (tmp_path / "1.zip").unlink()
    rows = [r for p in parts for r in reader.read(p)]
    assert [(r[1], r[5], r[6]) for r in rows][:2] == [("0.zip", None, b"x" * 40), ("1.zip", "absent", None)]
    middle = {"mtime_ns": parts[1].value[0][0], "path": parts[1].value[0][1]}
    assert sum(len(p.value) for p in reader.partitions(middle, reader.latestOffset())) == 3  # 1.zip is gone, 0 and 2 lie before


class Service:
    """A service of folders in a JSON file; each call leaves a mark beside it."""

    def __init__(self, root: Path, tree: dict, size: int = 3, flaky: bool = False):
        self.root, self.size, self.flaky = str(root), size, flaky
        Path(root, "tree.json").write_text(json.dumps(tree))
        Path(root, "calls").mkdir(exist_ok=True)

    def __call__(self, parent, token, wanted):
        calls = Path(self.root, "calls")
        mark = calls / f"{parent}-{token}-{time.time_ns()}"
        mark.write_text("")
        if self.flaky and len(list(calls.glob(f"{parent}-{token}-*"))) < 2:
            raise paged.Transient("once more")
        rows = json.loads(Path(self.root, "tree.json").read_text()).get(parent, [])
        rows = [r for r in rows if (wanted.names is None or r[1] in wanted.names) and r[1].startswith(wanted.prefix)]
        at = int(token or 0)
        return [tuple(r) for r in rows[at : at + self.size]], str(at + self.size) if at + self.size < len(rows) else None

    @property
    def calls(self):
        return len(list(Path(self.root, "calls").iterdir()))

    def forget(self):
        for p in Path(self.root, "calls").iterdir():
            p.unlink()


@pytest.fixture
def tree():
    return {"root": [(f"f{k}", f"name{k}", False) for k in range(10)] + [("d1", "inner", True), ("d2", "name", True)], "d1": [("g", "name3", False), ("d3", "deep", True)], "d2": [], "d3": [("h", "last", False), ("d1", "back", True)]}


def test_paged_listing_gives_what_one_listing_would(spark, tmp_path, tree):
    s = Service(tmp_path, tree)
    paged.register(spark, s)
    df = spark.read.format("cuemill_pages").option("parents", json.dumps(["root", "d1", "d2", "none"])).load()
    want = Counter((p, *r) for p in ("root", "d1", "d2") for r in tree[p])
    assert Counter(tuple(r) for r in df.collect()) == want
    assert s.calls == 4 + 1 + 1 + 1
    assert df.rdd.getNumPartitions() == 4


def test_names_reach_the_service(spark, tmp_path, tree):
    s = Service(tmp_path, tree)
    paged.register(spark, s)
    whole = paged.listed(spark, ["root"])
    for options, names in (({"names": ["name3"]}, {"name3"}), ({"names": ["name1", "inner", "no"]}, {"name1", "inner"}), ({"prefix": "in"}, {"inner"}), ({"names": ["inner", "name3"], "prefix": "in"}, {"inner"})):
        s.forget()
        assert {r.name for r in paged.listed(spark, ["root"], **options).collect()} == names
        assert s.calls == 1
    s.forget()
    assert paged.listed(spark, ["root"], names=[]).count() == 0 and s.calls == 0
    # one frame that is filtered in several ways gives each of them its rows
    assert whole.filter(F.col("name").startswith("in")).count() == 1 and whole.count() == 12
    assert whole.filter(F.col("name").startswith("in")).union(whole).count() == 13
    assert {r.name for r in whole.filter((F.col("name") == "name3") | F.col("is_folder")).collect()} == {"name3", "inner", "name"}


def test_transient_errors_are_tried_again_and_chains_end(tmp_path, tree):
    s = Service(tmp_path, tree, flaky=True)
    assert sum(len(p) for p in paged.pages(s, "root", wait=0)) == 12
    assert s.calls == 8
    with pytest.raises(paged.Transient):
        list(paged.pages(lambda *a: (_ for _ in ()).throw(paged.Transient()), "x", wait=0))
    with pytest.raises(RuntimeError, match="back to itself"):
        list(paged.pages(lambda p, t, w: ([], "again"), "x"))
    with pytest.raises(RuntimeError, match="more than 5 pages"):
        list(paged.pages(lambda p, t, w: ([], str(int(t or 0) + 1)), "x", most_pages=5))


def test_folders_are_walked_once(spark, tmp_path, tree):
    s = Service(tmp_path, tree)
    got = paged.walked(spark.createDataFrame([("root",)], "id string"), s)
    assert Counter((r.path, r.depth, r.is_folder) for r in got.collect()) == Counter(
        [(f"name{k}", 1, False) for k in range(10)] + [("inner", 1, True), ("name", 1, True), ("inner/name3", 2, False), ("inner/deep", 2, True), ("inner/deep/last", 3, False), ("inner/deep/back", 3, True)]
    )
    calls = s.calls
    assert calls == 4 + 1 + 1 + 1 and got.count() == 16 and s.calls == calls  # read again, not asked again
    with pytest.raises(RuntimeError, match="deeper"):
        paged.walked(spark.createDataFrame([("root",)], "id string"), s, most_depth=2)


def visible(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and not any(x.startswith(".") for x in p.relative_to(root).parts))


def test_publication_shows_all_or_nothing(spark, tmp_path):
    root = tmp_path / "site"
    docs = spark.range(40).select(F.concat(F.lit("m"), F.col("id") % 4, F.lit("/ü "), "id", F.lit("+1.vtt")).alias("name"), F.concat(F.lit("WEBVTT\n\n"), "id").alias("document"))
    told = publish.publish(docs, str(root), "v1")
    assert told["version"] == "v1" and told["documents"] == 40
    want = {(r.name, r.document) for r in docs.collect()}
    assert {(r.name, r.document) for r in publish.published(spark, str(root)).collect()} == want
    before = visible(root)

    @F.udf("string")
    def broken(k):
        if k == 33:
            raise ValueError("no such cue")
        return str(k)

    with pytest.raises(Exception, match="no such cue"):
        publish.publish(spark.range(40).select(F.col("id").cast("string").alias("name"), broken("id").alias("document")), str(root), "v2")
    assert visible(root) == before and not list(root.glob(".staging*"))
    assert {(r.name, r.document) for r in publish.published(spark, str(root)).collect()} == want
    # two of one name, and names that lead elsewhere, publish nothing either
    for rows, why in (([("a", "1"), ("b", "2"), ("a", "3")], "two documents"), ([("../a", "1")], "no name"), ([(None, "1")], "no name")):
        with pytest.raises(Exception, match=why):
            publish.publish(spark.createDataFrame(rows, "name string, document string"), str(root))
    assert visible(root) == before


def test_versions_follow_each_other(spark, tmp_path):
    root = tmp_path / "site"
    one = lambda k: spark.createDataFrame([("a", k)], "name string, document string")
    for k in ("1", "2", "3"):
        publish.publish(one(k), str(root), f"v{k}")
        assert [r.document for r in publish.published(spark, str(root)).collect()] == [k]
    assert publish.current(str(root))["earlier"] == ["v2"] and not (root / "v1").exists() and (root / "v2").exists()
    with pytest.raises(Exception, match="is there"):
        publish.publish(one("4"), str(root), "v3")
    assert [r.document for r in publish.published(spark, str(root)).collect()] == ["3"]
    publish.publish(one("5").limit(0), str(root), "v5")
    assert publish.published(spark, str(root)).count() == 0
    assert publish.publish(spark.createDataFrame([("raw", b"\x00\xff")], "name string, document binary"), str(root), "v6")["bytes"] == 2
