"""Listings of services that answer in pages."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.running import stored

SCHEMA = "parent string, id string, name string, is_folder boolean"
MOST_PAGES = 100_000
ATTEMPTS = 3


@dataclass(frozen=True)
class Wanted:
    """What of a folder is asked for: names (any of them) or a prefix of names; neither, all."""

    names: tuple[str, ...] | None = None
    prefix: str = ""


#: fetch(parent, token, wanted) -> (entries (id, name, is_folder), next token or None); the injected client of a service.
Fetch = Callable[[str, str | None, Wanted], tuple[list[tuple[str, str, bool]], str | None]]


class Transient(Exception):
    """What a client raises where the same call may succeed a moment later."""


def pages(fetch: Fetch, parent: str, wanted: Wanted = Wanted(), most_pages: int = MOST_PAGES, attempts: int = ATTEMPTS, wait: float = 0.5) -> Iterator[list[tuple[str, str, bool]]]:
    """The pages of one folder: each token is asked for once, and at most `attempts` times where calls are transient errors.

    A token that comes back, or a chain beyond most_pages, ends with an error instead of without end.
    """
    token, seen = None, set()
    for _ in range(most_pages):
        for attempt in range(attempts):
            try:
                entries, following = fetch(parent, token, wanted)
                break
            except Transient:
                if attempt + 1 == attempts:
                    raise
                time.sleep(wait * 2**attempt)
        yield list(entries)
        if not following:
            return
        if following in seen:
            raise RuntimeError(f"page {following!r} of {parent!r} leads back to itself")
        seen.add(following)
        token = following
    raise RuntimeError(f"{parent!r} has more than {most_pages} pages")


def paged_source(fetch: Fetch, source: str = "cuemill_pages") -> type[DataSource]:
    """A data source over fetch: options parents (JSON list of folder ids), names (JSON list) and prefix of what is asked for,
    most_pages, attempts.  Columns parent, id, name, is_folder.

    Each folder is a partition and walks its own chain of tokens, since a token is known only from the page before.  names and
    prefix reach the service, and are checked again here, as a service's equality may be case-blind.  They are options, and
    no pushed filters: Spark 4.1 keeps what was pushed once for all later queries over the same DataFrame, which then miss
    rows (a filter on a prefix and then a plain count gave 2 of 3 rows).
    """

    @dataclass
    class Reader(DataSourceReader):
        parents: list[str]
        wanted: Wanted
        most_pages: int
        attempts: int

        def partitions(self):
            return [InputPartition(p) for p in self.parents] if self.wanted.names != () else []

        def read(self, partition):
            w = self.wanted
            if partition is None:  # what Spark reads where there are no partitions
                return
            for page in pages(fetch, partition.value, w, self.most_pages, self.attempts):
                yield from ((partition.value, i, n, bool(d)) for i, n, d in page if n.startswith(w.prefix) and (w.names is None or n in w.names))

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return source

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            o = self.options
            names = json.loads(o["names"]) if o.get("names") else None
            wanted = Wanted(None if names is None else tuple(sorted(set(names))), o.get("prefix", ""))
            return Reader(json.loads(o.get("parents", "[]")), wanted, int(o.get("most_pages", MOST_PAGES)), int(o.get("attempts", ATTEMPTS)))

    return Paged


def register(spark: SparkSession, fetch: Fetch, source: str = "cuemill_pages") -> None:
    """Makes spark.read.format(source) read through fetch."""
    spark.dataSource.register(paged_source(fetch, source))


def listed(spark: SparkSession, parents: list[str], names: list[str] | None = None, prefix: str = "", source: str = "cuemill_pages") -> DataFrame:
    """The entries of folders: all, those of some names, or those whose name begins with prefix."""
    reader = spark.read.format(source).option("parents", json.dumps(parents)).option("prefix", prefix)
    return (reader if names is None else reader.option("names", json.dumps(names))).load()


def walked(folders: DataFrame, fetch: Fetch, most_depth: int = 32, most_pages: int = MOST_PAGES, attempts: int = ATTEMPTS) -> DataFrame:
    """parent, id, name, is_folder, depth, path of all that lies under folders (id), level by level.

    The folders of a level are rows, so they are dealt over all tasks and never come to the driver; each level is stored,
    so no folder is asked twice, whatever reads the result.  A folder that is met again (a shortcut to one above) is listed,
    but not walked again.  Beyond most_depth an error is raised.
    """
    cores = folders.sparkSession.sparkContext.defaultParallelism

    def ask(batches):
        for b in batches:
            for parent, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for page in pages(fetch, parent, most_pages=most_pages, attempts=attempts):
                    ids, names, kinds = zip(*page, strict=True) if page else ((), (), ())
                    whole = [f"{path}/{n}" if path else n for n in names]
                    cols = [pa.array([parent] * len(ids), pa.string()), pa.array(ids, pa.string()), pa.array(names, pa.string()), pa.array(kinds, pa.bool_()), pa.array(whole, pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names=["parent", "id", "name", "is_folder", "path"])

    level = stored(folders.select("id", F.lit("").alias("path")).distinct(), "walk-roots")
    seen, out = level.select("id"), None
    for depth in range(1, most_depth + 2):
        if level.isEmpty():
            return out
        if depth > most_depth:
            raise RuntimeError(f"folders lie deeper than {most_depth} levels")
        found = level.repartition(cores, "id").select("id", "path").mapInArrow(ask, SCHEMA + ", path string").withColumn("depth", F.lit(depth))
        found = stored(found, "walk-level")
        out = found if out is None else out.unionByName(found)
        inner = found.filter("is_folder").select("id", "path").dropDuplicates(["id"])
        level = stored(inner.join(seen, "id", "left_anti"), "walk-next")
        seen = seen.unionByName(level.select("id"))
    return out
