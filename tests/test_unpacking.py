"""Archives planned from their directories and unpacked member by member."""

import hashlib
import io
import random
import zipfile

import pytest

from cuemill.operators import unpacking


def zipped(members, method=zipfile.ZIP_DEFLATED, mode=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members:
            info = zipfile.ZipInfo(name)
            info.compress_type = method
            if mode and name in mode:
                info.external_attr = mode[name] << 16
            z.writestr(info, data)
    return out.getvalue()


def plan(spark, folder, **limits):
    paths = [(str(p),) for p in sorted(folder.glob("*.zip"))]
    return unpacking.planned(spark.createDataFrame(paths, "path string"), **limits)


def name_of(r):
    return r.archive.rsplit("/", 1)[-1]


def tree_of(root):
    return {str(p.relative_to(root)).split("/", 1)[1]: p.read_bytes() for p in root.rglob("*") if p.is_file()}


@pytest.mark.parametrize(("outer", "inner"), [(zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED), (zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED)])
def test_members_at_every_depth(spark, tmp_path, outer, inner):
    r = random.Random(1)
    big = r.randbytes(3 << 20) + bytes(3 << 20)
    deepest = zipped([("deep.mov", b"d" * 70_000), ("n.txt", b"n")], inner)
    middle = zipped([("sub/deep.zip", deepest), ("x.mp4", big)], inner)
    (tmp_path / "a b+%20.zip").write_bytes(zipped([("v.MP4", b"video"), ("dir/", b""), ("dir/middle.zip", middle), ("e.txt", b""), ("__MACOSX/j.zip", b"no zip")], outer))
    got = plan(spark, tmp_path)
    rows = sorted(got.collect(), key=lambda r: (r.container, r.idx))
    assert [(list(r.container), r.name, r.kind, r.files) for r in rows] == [
        ([], "v.MP4", "media", 1), ([], "dir/", None, 1), ([], "dir/middle.zip", "nested_zip", 2), ([], "e.txt", "ignored", 3), ([], "__MACOSX/j.zip", None, 3),
        ([2], "sub/deep.zip", "nested_zip", 4), ([2], "x.mp4", "media", 5), ([2, 0], "deep.mov", "media", 6), ([2, 0], "n.txt", "ignored", 7),
    ]
    assert rows[-1].bytes == sum(r.size for r in rows if not r.junk) and not any(r.fault for r in rows)
    assert unpacking.refused(got).count() == 0
    done = unpacking.extracted(got, str(tmp_path / "out"), task_bytes=1 << 20).collect()
    want = {"a b+%20/v.MP4": b"video", "a b+%20/e.txt": b"", "a b+%20/dir/middle/x.mp4": big, "a b+%20/dir/middle/sub/deep/deep.mov": b"d" * 70_000, "a b+%20/dir/middle/sub/deep/n.txt": b"n"}
    assert tree_of(tmp_path / "out") == want
    assert {(r.target.split("/", 1)[1], r.size, r.sha256, r.error) for r in done} == {(k, len(v), hashlib.sha256(v).hexdigest(), None) for k, v in want.items()}


def faults(spark, tmp_path, **limits):
    return {(name_of(r), r.fault, tuple(r.container), r.name) for r in unpacking.refused(plan(spark, tmp_path, **limits)).collect()}


def test_what_is_wrong_with_an_archive(spark, tmp_path):
    put = lambda name, data: (tmp_path / f"{name}.zip").write_bytes(data)
    put("good", zipped([("a.mp4", b"1")]))
    put("no", b"this is no archive")
    put("parent", zipped([("a.mp4", b"1"), ("../evil", b"2"), ("/abs", b"3")]))
    put("reserved", zipped([("x/CON.txt", b"1")]))
    put("link", zipped([("l", b"target")], mode={"l": 0o120777}))
    put("case", zipped([("Café.txt", b"1"), ("café.TXT", b"2")]))
    put("inside", zipped([("fine.mp4", b"1"), ("in.zip", zipped([("../evil", b"2")]))]))
    put("broken", zipped([("in.zip", b"no archive")]))
    put("folder", zipped([("x.zip", zipped([("v.mp4", b"1")])), ("x/w.mp4", b"2")]))
    put("twins", zipped([("x.zip", zipped([("v.mp4", b"1")])), ("x .zip", zipped([("w.mp4", b"1")]))]))
    assert faults(spark, tmp_path) == {
        ("no.zip", "unreadable", (), None), ("parent.zip", "parent", (), "../evil"), ("reserved.zip", "reserved", (), "x/CON.txt"), ("link.zip", "symlink", (), "l"),
        ("case.zip", "collision", (), "café.TXT"), ("inside.zip", "parent", (1,), "../evil"), ("broken.zip", "unreadable", (0,), None), ("folder.zip", "folder", (), "x.zip"), ("twins.zip", "folder", (), "x .zip"),
    }
    done = unpacking.extracted(plan(spark, tmp_path), str(tmp_path / "out")).collect()
    assert [r.target.split("/", 1)[1] for r in done] == ["good/a.mp4"] and set(tree_of(tmp_path / "out")) == {"good/a.mp4"}


def test_limits(spark, tmp_path):
    levels = zipped([("v.mp4", b"x" * 50)])
    for k in range(2):
        levels = zipped([(f"l{k}.zip", levels), (f"w{k}.mp4", b"y" * 10), ("__MACOSX/j", b"j" * 999)], zipfile.ZIP_STORED if k % 2 else zipfile.ZIP_DEFLATED)
    (tmp_path / "deep.zip").write_bytes(levels)
    total = max(r.bytes for r in plan(spark, tmp_path).collect())
    assert faults(spark, tmp_path, most_depth=2, most_files=5, most_bytes=total) == set()
    assert faults(spark, tmp_path, most_depth=1) == {("deep.zip", "depth", (0,), "l0.zip")}
    assert faults(spark, tmp_path, most_files=4) == {("deep.zip", "files", (0, 0), "v.mp4")}
    assert faults(spark, tmp_path, most_bytes=total - 1) == {("deep.zip", "bytes", (0, 0), "v.mp4")}
    assert {f[1] for f in faults(spark, tmp_path, most_bytes=5)} == {"bytes"}


def test_contents_that_differ_from_their_directory(spark, tmp_path):
    whole = zipped([("a.mp4", b"A" * 5000), ("b.mp4", b"B" * 5000)], zipfile.ZIP_STORED)
    hurt = bytearray(whole)
    hurt[whole.index(b"BBBB") + 100] = 0
    (tmp_path / "hurt.zip").write_bytes(hurt)
    locked = bytearray(whole)
    for k in range(len(locked) - 4):
        if locked[k : k + 4] in (b"PK\x01\x02",):
            locked[k + 8] |= 1
    (tmp_path / "locked.zip").write_bytes(locked)
    done = {(name_of(r), r.target.rsplit("/", 1)[-1]): r.error for r in unpacking.extracted(plan(spark, tmp_path), str(tmp_path / "out")).collect()}
    assert done[("hurt.zip", "a.mp4")] is None and "checksum" in done[("hurt.zip", "b.mp4")]
    assert "encrypted" in done[("locked.zip", "a.mp4")]
    assert [p.name for p in (tmp_path / "out").rglob("*") if p.is_file()] == ["a.mp4"]


def test_names_without_the_flag_are_repaired(spark, tmp_path):
    raw = zipped([("compresión.wmv", b"1")])
    out = bytearray(raw)
    for k in range(len(out) - 4):  # the same bytes, without the UTF-8 flag
        if out[k : k + 4] == b"PK\x03\x04":
            out[k + 7] &= ~0x08
        elif out[k : k + 4] == b"PK\x01\x02":
            out[k + 9] &= ~0x08
    (tmp_path / "macos.zip").write_bytes(out)
    r = plan(spark, tmp_path).first()
    assert r.member == "compresión.wmv" and r.target.endswith("/macos/compresión.wmv") and not r.utf8_flag


def test_pieces_are_bounded(tmp_path):
    path = tmp_path / "zeros.zip"
    path.write_bytes(zipped([("z", bytes(40 << 20))]))
    assert path.stat().st_size < 100_000
    row = unpacking._directory(str(path), 0, -1)[0]
    pieces = [len(p) for p in unpacking._bytes_of(str(path), 0, -1, row[8], row[4], row[3], row[5], row[6], row[7])]
    assert sum(pieces) == 40 << 20 and max(pieces) <= unpacking.CHUNK
    with pytest.raises(ValueError, match="longer"):
        list(unpacking._bytes_of(str(path), 0, -1, row[8], row[4], 10 << 20, row[5], row[6], row[7]))


def test_no_archives(spark, tmp_path):
    got = unpacking.planned(spark.createDataFrame([], "path string"))
    assert got.collect() == [] and unpacking.refused(got).collect() == [] and unpacking.extracted(got, str(tmp_path)).collect() == []
