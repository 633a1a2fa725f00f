"""Nested archives: the tree of containers, and expansion of ZIP files."""

from __future__ import annotations

import io
import re
import shutil
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.uris import is_junk, member_fault


_JUNK = re.compile(r"(^|/)__MACOSX/|\.DS_Store$")  # as uris.is_junk


def tree(items: DataFrame, most_depth: int) -> DataFrame:
    """id, depth, path of what hangs below the roots (id, parent; a root's parent is null), at most most_depth levels deep.

    One join for each level, so a cycle ends with the levels.
    """
    level = items.filter("parent is null").select("id", F.lit(0).alias("depth"), F.col("id").alias("path"))
    out = level
    for depth in range(1, most_depth + 1):
        above = level.select(F.col("id").alias("parent"), "path")
        level = items.join(above, "parent").select("id", F.lit(depth).alias("depth"), F.concat_ws("/", "path", "id").alias("path"))
        out = out.unionByName(level)
    return out


def _members(source, path: str, depth: int, limits: tuple, state: dict, contents: bool):
    """Rows of a ZIP file's members, and then of those of the ZIP files in it; only these, and what is asked for, are inflated.

    All members of a file count before any of the files in it is opened; junk counts for nothing and is never opened.
    """
    most_depth, most_files, most_bytes = limits
    with zipfile.ZipFile(source) as z:
        inner = []
        for info in z.infolist():
            if info.is_dir():
                continue
            link = (info.external_attr >> 16) & 0o170000 == 0o120000
            junk = _JUNK.search(info.filename.replace("\\", "/")) is not None
            state["files"] += not junk
            state["bytes"] += 0 if junk else info.file_size
            nested = info.filename.lower().endswith(".zip") and not link and not junk
            limit = None if junk else "files" if state["files"] > most_files else "bytes" if state["bytes"] > most_bytes else "depth" if nested and depth == most_depth else None
            yield (path, depth, None if junk else state["files"], info.filename, bool(info.flag_bits & 0x800), info.file_size, link, limit), z.read(info) if contents and not limit and not junk else None
            if limit:
                state["over"] = True
                return
            inner += [info] * nested
        for info in inner:
            with tempfile.SpooledTemporaryFile(max_size=64 << 20) as held:
                with z.open(info) as data:
                    shutil.copyfileobj(data, held, 1 << 20)
                held.seek(0)
                yield from _members(held, f"{path}/{info.filename}", depth + 1, limits, state, contents)
                if state["over"]:
                    return


def expanded(archives: DataFrame, most_depth: int = 5, most_files: int = 10_000, most_bytes: int = 10 << 30, contents: bool = False) -> DataFrame:
    """A row for each member of ZIP archives (path, content) and of archives in them: for archives that fit into a row; unpacking
    plans those of any size.

    archive, container, depth, pos (null for junk, which counts for nothing), name, utf8_flag, size, is_symlink, limit (files,
    bytes or depth: exceeded here; nothing follows), error, junk, fault (of the name), and content if asked for.  A file's
    members come, and count, before those of files in it.  An archive within itself exceeds the depth.  Files that are no
    ZIP have an error.
    """
    names = ["archive", "container", "depth", "pos", "name", "utf8_flag", "size", "is_symlink", "limit", "error", "content"]
    schema = T.StructType.fromDDL("archive string, container string, depth int, pos long, name string, utf8_flag boolean, size long, is_symlink boolean, limit string, error string, content binary")

    def open_(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out, state = [], {"files": 0, "bytes": 0, "over": False}
                try:
                    for row, data in _members(io.BytesIO(content or b""), path, 0, (most_depth, most_files, most_bytes), state, contents):
                        out.append((path, *row, None, data if contents else None))
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError) as e:
                    out.append((path, path, 0, None, None, None, None, None, None, f"{type(e).__name__}: {e}", None))
                cols = list(zip(*out, strict=True)) or [()] * len(names)
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    rows = archives.select("path", "content").mapInArrow(open_, schema)
    out = rows.withColumn("junk", is_junk(F.col("name"))).withColumn("fault", member_fault(F.col("name"), F.col("is_symlink")))
    return out if contents else out.drop("content")
