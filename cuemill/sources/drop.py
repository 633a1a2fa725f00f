"""A drop folder as a stream source: each file once it has settled, and once only."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from datetime import UTC, datetime
from fnmatch import fnmatchcase

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

CHUNK = 1 << 20
TASK_BYTES = 128 << 20
SCHEMA = "path string, name string, mtime timestamp, size long, sha256 string, error string"


class DropFolder(DataSource):
    """spark.readStream.format("cuemill_drop").option("root", uri).load(): a row for each file under root that has settled.

    path, name, mtime, size, sha256 of the content, error ("absent" for a file that went before it was read), and content
    with option content=true.  Options: pattern (of names, case-blind; *.zip), min_age (seconds that a file must have been
    left alone; 60), task_bytes (how much one task reads).

    The offset is a frontier: the modification time and path of the last settled file.  A young file has a time that is later
    than any settled one, so it stays beyond the frontier until it has settled, and one that is written to again moves
    behind it.  A batch is what lies between two frontiers, so a restart gives the same files again and no others; what
    is behind the frontier is listed, but never opened.  A file that comes with an older time of its own (copied with
    its times kept) is behind the frontier: `polling.poll`, which asks the registry, is for such folders.
    """

    @classmethod
    def name(cls):
        return "cuemill_drop"

    def schema(self):
        return SCHEMA + (", content binary" if self.options.get("content", "").lower() == "true" else "")

    def streamReader(self, schema):
        o = self.options
        return DropReader(o.get("root"), o.get("pattern", "*.zip"), float(o.get("min_age", 60)), int(o.get("task_bytes", TASK_BYTES)), o.get("content", "").lower() == "true")


class DropReader(DataSourceStreamReader):
    def __init__(self, root: str | None, pattern: str, min_age: float, task_bytes: int, content: bool):
        if not root:
            raise ValueError("option root is needed")
        self.root, self.pattern, self.min_age, self.task_bytes, self.content = root if "://" in root else f"file://{root}", pattern.lower(), min_age, task_bytes, content

    def _settled(self) -> Iterator[tuple[int, str, int]]:
        """(time in ns, path, size) of the files that have settled by now."""
        system, root = pafs.FileSystem.from_uri(self.root)
        latest = time.time_ns() - int(self.min_age * 1e9)
        for f in system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
            if f.is_file and f.mtime_ns <= latest and fnmatchcase(f.base_name.lower(), self.pattern):
                yield f.mtime_ns, f.path, f.size

    def initialOffset(self) -> dict:
        return {"mtime_ns": 0, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((at, path) for at, path, _ in self._settled()), default=(0, ""))
        return {"mtime_ns": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """The files between two frontiers, in groups of task_bytes or one file."""
        low, high = ((o["mtime_ns"], o["path"]) for o in (start, end))
        groups: list[list] = []
        room = 0
        for f in sorted(x for x in self._settled() if low < x[:2] <= high):
            if not groups or f[2] > room:
                groups.append([])
                room = self.task_bytes
            groups[-1].append(f)
            room -= f[2]
        return [InputPartition(g) for g in groups]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = pafs.FileSystem.from_uri(self.root)
        for at, path, size in partition.value if partition else ():
            digest, parts, error = hashlib.sha256(), [], None
            try:
                with system.open_input_stream(path) as f:
                    while part := f.read(CHUNK):
                        digest.update(part)
                        if self.content:
                            parts.append(part)
            except FileNotFoundError:
                error = "absent"
            row = path, path.rsplit("/", 1)[-1], datetime.fromtimestamp(at / 1e9, UTC), size, None if error else digest.hexdigest(), error
            yield (*row, None if error else b"".join(parts)) if self.content else row

    def commit(self, end: dict) -> None:
        """Nothing is held for what has been processed."""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DropFolder)
