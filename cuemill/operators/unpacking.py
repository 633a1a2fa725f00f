"""ZIP archives of any size: planned from their central directories, unpacked member by member.

Nothing reads an archive whole.  A plan has a row for each member of an archive and of the archives in it; each row tells
where its bytes lie, so the members of one archive are unpacked side by side, in pieces.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import repaired_member, safe_directory, without_suffix
from ..functions.uris import is_junk, media_class, member_fault
from ..sources.outputs import located
from .lineage import shared_dir
from .running import stored

CHUNK = 1 << 20
TASK_BYTES = 256 << 20
LEVEL = "archive string, container array<int>, folder string, file string, start long, length long"
ENTRY = "idx int, name string, utf8_flag boolean, size long, packed long, method int, flags int, crc long, header long, is_dir boolean, is_symlink boolean, error string"
_KEY = ["archive", "container", "idx"]


class _View(io.RawIOBase):
    """A part of an open file, as a file."""

    def __init__(self, file, start: int, length: int):
        self.file, self.begin, self.size, self.at = file, start, file.size() - start if length < 0 else length, 0

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, offset, whence=0):
        self.at = max(0, offset + (0, self.at, self.size)[whence])
        return self.at

    def tell(self):
        return self.at

    def readinto(self, into):
        n = min(len(into), max(0, self.size - self.at))
        self.file.seek(self.begin + self.at)
        data = self.file.read(n)
        into[: len(data)] = data
        self.at += len(data)
        return len(data)


def _opened(path: str):
    system, name = located(path)
    return system.open_input_file(name)


def _directory(path: str, start: int, length: int) -> list[tuple]:
    """The central directory of the archive in a part of a file; only its end is read."""
    with _opened(path) as f, zipfile.ZipFile(io.BufferedReader(_View(f, start, length), 1 << 16)) as z:
        return [
            (k, i.filename, bool(i.flag_bits & 0x800), i.file_size, i.compress_size, i.compress_type, i.flag_bits, i.CRC, i.header_offset, i.is_dir(), (i.external_attr >> 16) & 0o170000 == 0o120000, None)
            for k, i in enumerate(z.infolist())
        ]


def _bytes_of(path: str, start: int, length: int, header: int, packed: int, size: int, method: int, flags: int, crc: int) -> Iterator[bytes]:
    """The content of a member in pieces of at most CHUNK; what disagrees with its directory entry is an error."""
    if flags & 1:
        raise ValueError("encrypted")
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"compression method {method}")
    with _opened(path) as f:
        view = _View(f, start, length)
        view.seek(header)
        local = view.read(30)
        if len(local) < 30 or local[:4] != b"PK\x03\x04":
            raise ValueError("no local header")
        names, extra = struct.unpack("<HH", local[26:30])
        view.seek(header + 30 + names + extra)
        inflate = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None
        left, given, check = packed, 0, 0
        held = b""
        while True:
            if not held and left:
                held = view.read(min(CHUNK, left))
                if not held:
                    raise ValueError("cut short")
                left -= len(held)
            if inflate is None:
                part, held = held, b""
            else:
                part = inflate.decompress(held, CHUNK)
                held = inflate.unconsumed_tail
            given += len(part)
            if given > size:
                raise ValueError("longer than its directory entry says")
            check = zlib.crc32(part, check)
            if part:
                yield part
            elif not held and not left:
                break
        if given != size or check != crc or (inflate is not None and not inflate.eof):
            raise ValueError("checksum or length differs")


def _directories(batches):
    for b in batches:
        cols = b.to_pydict()
        for k in range(b.num_rows):
            level = [cols[n][k] for n in b.schema.names]
            try:
                rows = _directory(level[3], level[4], level[5])
            except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, EOFError, struct.error) as e:
                rows = [(-1, *[None] * 10, f"{type(e).__name__}: {e}")]
            for i in range(0, len(rows), 10_000):
                some = list(zip(*rows[i : i + 10_000], strict=True))
                n = len(some[0])
                same = [pa.array([v] * n, t) for v, t in zip(level, (pa.string(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)]
                kinds = (pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, t) for c, t in zip(some, kinds, strict=True))], names=[*b.schema.names, *(x.split()[0] for x in ENTRY.split(", "))])


@F.pandas_udf(T.StringType())
def _folded(path: pd.Series) -> pd.Series:
    import unicodedata

    return path.map(lambda p: None if p is None else unicodedata.normalize("NFC", p).casefold())


_SOURCE = ["file", "start", "length", "header", "packed", "size", "method", "flags", "crc"]


def _scratch(root: str):
    """Inflates archives within archives into files of their own: their directory is at their end, and deflate has no way there.

    A file gets its name, which is that of its member, once it is whole; another attempt puts the same in its place.
    """

    def run(batches):
        system, base = located(root)
        for b in batches:
            cols, files, errors = b.to_pydict(), [], []
            for k in range(b.num_rows):
                name = hashlib.sha256(repr([cols[c][k] for c in _KEY]).encode()).hexdigest()
                part, error = f"{base}/.{name}.{uuid.uuid4().hex}", None
                system.create_dir(base, recursive=True)
                try:
                    with system.open_output_stream(part) as out:
                        for piece in _bytes_of(*(cols[c][k] for c in _SOURCE)):
                            out.write(piece)
                    system.move(part, f"{base}/{name}.zip")
                except (ValueError, zlib.error) as e:
                    system.delete_file(part)
                    error = f"{type(e).__name__}: {e}"
                files.append(f"{root}/{name}.zip")
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in _KEY), pa.array(files), pa.array(errors, pa.string())], names=[*_KEY, "scratch", "broken"])

    return run


def _named(found: DataFrame) -> DataFrame:
    """Directory entries with what their names say: member (repaired, in NFC), target, kind, junk, fault."""
    member = F.when(F.col("name").isNotNull(), repaired_member("name", "utf8_flag"))
    out = found.withColumn("member", member).withColumn("junk", F.coalesce(is_junk(F.col("name")), F.lit(False)))
    out = out.withColumn("target", F.concat_ws("/", "folder", F.regexp_replace(F.regexp_replace("member", r"(^|/)(\./)+", "$1"), r"/+$|^/+", "")))
    out = out.withColumn("kind", F.when(F.col("is_dir") | F.col("junk") | F.col("error").isNotNull(), F.lit(None)).otherwise(media_class(F.col("member"))))
    same = Window.partitionBy("archive", "container", _folded(F.col("target"))).orderBy("idx")
    twice = (F.row_number().over(same) > 1) & ~F.col("junk") & F.col("member").isNotNull()
    fault = F.when(F.col("error").isNotNull(), "unreadable").when(F.col("junk"), None).otherwise(F.coalesce(member_fault(F.col("member"), F.col("is_symlink")), F.when(twice, "collision")))
    return out.withColumn("fault", fault)


def planned(archives: DataFrame, most_depth: int = 5, most_files: int = 10_000, most_bytes: int = 10 << 30) -> DataFrame:
    """A row for each member of the ZIP archives (path) and of the archives in them, from their directories alone.

    archive, container (the places of the archives that lead to it, outermost first), depth, idx, name, member (as it is
    read), target (below a folder of its archive), size, kind (media, nested_zip, ignored), junk, fault, files and bytes
    (counted up to here), and where its bytes are.  fault is the first thing that is wrong with a member: unreadable, a
    fault of its name, collision (with a path before it), folder (the folder that an archive is unpacked to is there
    already), depth (an archive deeper than most_depth), files or bytes (a limit is passed here).  Junk is listed and
    counts for nothing.  An archive's members count in their order, all of them before those of archives in it.

    Each level of archives is one pass over all of them.  Archives that are stored without compression are read where they
    lie; others are inflated once, into the folder of spark.checkpoint.dir.  Archives in which something is wrong are
    not opened any deeper, so nested bombs stay folded: what is inflated is within most_bytes.
    """
    spark = archives.sparkSession
    root = f"{shared_dir(spark)}/cuemill/unpack-{uuid.uuid4().hex}"
    most_tasks = spark.sparkContext.defaultParallelism * 4
    tasks = lambda rows: max(1, min(most_tasks, rows.count()))  # noqa: E731  a row is an archive: little to send, much to do
    stem = without_suffix(F.regexp_extract("path", "[^/]*$", 0))
    own = F.concat_ws("/", F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 16), safe_directory(stem))
    level = archives.select(F.col("path").alias("archive"), F.array().cast("array<int>").alias("container"), own.alias("folder"), F.col("path").alias("file"), F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("length"))
    level = level.withColumn("broken", F.lit(None).cast("string"))
    plan = None
    for depth in range(most_depth + 1):
        dealt = level.filter("broken is null").drop("broken").repartition(tasks(level), "archive", "container")
        found = _named(dealt.mapInArrow(_directories, f"{LEVEL}, {ENTRY}")).withColumn("depth", F.lit(depth))
        if depth:  # archives that could not be inflated
            lost = level.filter("broken is not null")
            extra = [F.lit(None).cast(t).alias(n) for n, t in found.dtypes if n not in ("archive", "container", "folder", "file", "start", "length", "depth", "idx", "error", "fault", "junk")]
            lost = lost.select("archive", "container", "folder", "file", "start", "length", F.lit(depth).alias("depth"), F.lit(-1).alias("idx"), F.col("broken").alias("error"), F.lit("unreadable").alias("fault"), F.lit(False).alias("junk"), *extra)
            found = found.unionByName(lost.select(*found.columns))
        nested = (F.col("kind") == "nested_zip") & F.col("fault").isNull()
        found = found.withColumn("inner", F.when(nested, F.concat_ws("/", F.regexp_extract("target", "^(.*)/[^/]*$", 1), safe_directory(without_suffix(F.regexp_extract("target", "[^/]*$", 0))))))
        if depth == most_depth:
            found = found.withColumn("fault", F.when(nested, "depth").otherwise(F.col("fault")))
        found = stored(found, "unpack-level")
        if depth < most_depth:
            found = stored(_folder_faults(found), "unpack-folders")
        plan = found if plan is None else plan.unionByName(found)
        if depth == most_depth:
            break
        counted = plan.filter("not junk and not coalesce(is_dir, false)").groupBy("archive").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.count("fault").alias("wrong"))
        sound = counted.filter((F.col("n") <= most_files) & (F.col("b") <= most_bytes) & (F.col("wrong") == 0)).select("archive")
        inside = stored(found.filter((F.col("kind") == "nested_zip") & F.col("fault").isNull()).join(sound, "archive", "left_semi"), "unpack-nested")
        if inside.isEmpty():
            break
        plain = (F.col("method") == 0) & (F.col("flags").bitwiseAND(F.lit(1)) == 0)
        packed = inside.filter(~plain).select(*_KEY, *[c for c in _SOURCE])
        made = stored(packed.repartition(tasks(packed), *_KEY).mapInArrow(_scratch(root), "archive string, container array<int>, idx int, scratch string, broken string"), "unpack-scratch")
        heads = inside.filter(plain).select(*_KEY, *_SOURCE).mapInArrow(_stored_places, "archive string, container array<int>, idx int, at long, broken string")
        deeper = F.concat("container", F.array("idx")).alias("container")
        a = inside.filter(~plain).join(made, _KEY).select("archive", deeper, F.col("inner").alias("folder"), F.col("scratch").alias("file"), F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("length"), "broken")
        b = inside.filter(plain).join(heads, _KEY).select("archive", deeper, F.col("inner").alias("folder"), "file", F.col("at").alias("start"), F.col("size").alias("length"), "broken")
        level = stored(a.unionByName(b), "unpack-next")
    counts = F.when(~F.col("junk") & ~F.coalesce("is_dir", F.lit(False)) & F.col("size").isNotNull(), 1).otherwise(0)
    w = Window.partitionBy("archive").orderBy("container", "idx").rowsBetween(Window.unboundedPreceding, 0)
    out = plan.withColumn("files", F.sum(counts).over(w)).withColumn("bytes", F.sum(F.when(counts == 1, F.col("size")).otherwise(0)).over(w))
    over = F.when(counts == 0, None).when(F.col("files") > most_files, "files").when(F.col("bytes") > most_bytes, "bytes")
    return stored(out.withColumn("fault", F.coalesce("fault", over)).drop("inner"), "unpack-plan")


def _stored_places(batches):
    """Where the bytes of members without compression begin in their file: behind the local header, whose length only it tells."""
    for b in batches:
        cols, at, broken = b.to_pydict(), [], []
        for k in range(b.num_rows):
            with _opened(cols["file"][k]) as f:
                view = _View(f, cols["start"][k], cols["length"][k])
                view.seek(cols["header"][k])
                local = view.read(30)
            good = len(local) == 30 and local[:4] == b"PK\x03\x04"
            at.append(cols["start"][k] + cols["header"][k] + 30 + sum(struct.unpack("<HH", local[26:30])) if good else None)
            broken.append(None if good else "ValueError: no local header")
        yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in _KEY), pa.array(at, pa.int64()), pa.array(broken, pa.string())], names=[*_KEY, "at", "broken"])


def _folder_faults(found: DataFrame) -> DataFrame:
    """Marks archives whose folder is there already: a path of their own archive's members, or the folder of one before it."""
    steps = F.split("target", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    there = found.filter("member is not null and not junk").select("archive", "container", F.explode(above).alias("inner")).distinct().withColumn("_there", F.lit(True))
    out = found.join(there, ["archive", "container", "inner"], "left")
    again = F.row_number().over(Window.partitionBy("archive", "container", "inner").orderBy("idx")) > 1
    return out.withColumn("fault", F.coalesce("fault", F.when(F.col("inner").isNotNull() & (F.col("_there").isNotNull() | again), "folder"))).select(*found.columns)


def refused(plan: DataFrame) -> DataFrame:
    """archive, fault, container, name of the first thing that is wrong with each archive that is not to be unpacked."""
    first = F.min_by(F.struct("fault", "container", "name"), F.struct("container", "idx"))
    return plan.filter("fault is not null").groupBy("archive").agg(first.alias("f")).select("archive", "f.*")


def extracted(plan: DataFrame, root: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Writes the members of all archives that nothing is wrong with below root, each at its target; archive, target, kind, size,
    sha256, error of each.  What was filtered out of plan is not unpacked; archives in archives are unpacked themselves.

    Members are dealt out one by one, in about as many tasks as task_bytes asks for, and copied in pieces: memory does not
    depend on their size.  A file has its name once it is whole and its checksum is right.  The result is stored, so
    reading it twice unpacks once.
    """
    spark = plan.sparkSession
    good = plan.filter("not junk and not is_dir and kind <> 'nested_zip'").join(refused(plan).select("archive"), "archive", "left_anti")
    good = stored(good, "unpack-members")
    n = max(spark.sparkContext.defaultParallelism, -(-int(good.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) // task_bytes))

    def write(batches):
        system, base = located(root)
        for b in batches:
            cols, shas, errors = b.to_pydict(), [], []
            for k in range(b.num_rows):
                target = f"{base.rstrip('/')}/{cols['target'][k]}"
                folder = target.rsplit("/", 1)[0]
                system.create_dir(folder, recursive=True)
                part, digest, error = f"{folder}/.{uuid.uuid4().hex}.part", hashlib.sha256(), None
                try:
                    with system.open_output_stream(part) as out:
                        for piece in _bytes_of(*(cols[c][k] for c in _SOURCE)):
                            digest.update(piece)
                            out.write(piece)
                    system.move(part, target)
                except (ValueError, zlib.error) as e:
                    system.delete_file(part)
                    error = f"{type(e).__name__}: {e}"
                shas.append(None if error else digest.hexdigest())
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("archive", "target", "kind", "size")), pa.array(shas, pa.string()), pa.array(errors, pa.string())], names=["archive", "target", "kind", "size", "sha256", "error"])

    rows = good.select("archive", "target", "kind", *_SOURCE).repartition(n, "archive", "target")
    return stored(rows.mapInArrow(write, "archive string, target string, kind string, size long, sha256 string, error string"), "unpack-done")
