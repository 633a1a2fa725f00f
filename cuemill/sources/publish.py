"""Publishing many documents at once: all of them are seen, or none."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .outputs import Outputs

POINTER = "_current.json"


@dataclass
class Written(WriterCommitMessage):
    """Where one task left its documents, and how many they are."""

    folder: str
    documents: int
    bytes: int


class Documents(DataSource):
    """df.write.format("cuemill_documents").option("root", uri).mode("append").save(), for rows of name and document.

    Tasks write to a hidden folder; only the commit, once all of them have succeeded, gives it a name and has the pointer tell
    of it, each by one rename.  Attempts that failed, or ran twice, wrote to folders of their own, which no commit
    mentions.  Option version names the new version (a random one else); keep says how many earlier ones stay (1).
    """

    @classmethod
    def name(cls):
        return "cuemill_documents"

    def schema(self):
        return "name string, document string"

    def writer(self, schema, overwrite):
        if not self.options.get("root"):
            raise ValueError("option root is needed")
        return DocumentsWriter(self.options["root"], self.options.get("version") or uuid.uuid4().hex, int(self.options.get("keep", 1)), [f.name for f in schema.fields])


class DocumentsWriter(DataSourceArrowWriter):
    def __init__(self, root: str, version: str, keep: int, columns: list[str]):
        if "name" not in columns or "document" not in columns:
            raise ValueError("rows are to have name and document")
        if version.startswith((".", "_")) or "/" in version:
            raise ValueError(f"no name of a version: {version!r}")
        self.root, self.version, self.keep, self.columns = root, version, keep, columns
        self.staging = f".staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        out, own, seen, size = Outputs(self.root), f"part-{uuid.uuid4().hex}", set(), 0
        for batch in iterator:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for name, document in zip(cols["name"].to_pylist(), cols["document"].to_pylist(), strict=True):
                parts = (name or "").split("/")
                if not name or any(p in ("", ".", "..") for p in parts):
                    raise ValueError(f"no name of a document: {name!r}")
                if name in seen:
                    raise ValueError(f"two documents are called {name!r}")
                seen.add(name)
                data = document if isinstance(document, bytes) else (document or "").encode()
                out.write(data, self.staging, own, *parts)
                size += len(data)
        return Written(own, len(seen), size)

    def commit(self, messages: list) -> None:
        out = Outputs(self.root)
        done = [m for m in messages if m and m.documents]
        if out.exists(self.version):
            self.abort(messages)
            raise FileExistsError(f"version {self.version!r} is there")
        for folder in set(out.names(self.staging, folders=True)) - {m.folder for m in done}:
            out.delete(self.staging, folder)  # of attempts that don't count
        before = current(self.root)
        if done:
            out.move(self.staging, self.version)
        else:
            out.fs.create_dir(out.at(self.version), recursive=True)
        kept = [v for v in ([before["version"], *before["earlier"]] if before else [])]
        told = {"version": self.version, "documents": sum(m.documents for m in done), "bytes": sum(m.bytes for m in done), "earlier": kept[: self.keep]}
        out.write(json.dumps(told, indent=2).encode(), POINTER)  # from here on the new version is what is published
        for old in kept[self.keep :]:
            out.delete(old)

    def abort(self, messages: list) -> None:
        Outputs(self.root).delete(self.staging)


def current(root: str) -> dict | None:
    """What the pointer tells: version, documents, bytes, earlier; null where nothing was published."""
    out = Outputs(root)
    return json.loads(out.read(POINTER)) if out.exists(POINTER) else None


def publish(documents: DataFrame, root: str, version: str | None = None, keep: int = 1) -> dict:
    """Writes documents (name, document: text or bytes) as one new version of root, and returns what its pointer tells.

    Names are relative paths; two of one name meet in one task, which fails, and so does the whole.
    """
    spark = documents.sparkSession
    spark.dataSource.register(Documents)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = documents.select("name", "document").repartition(n, "name").write.format("cuemill_documents").option("root", root).option("keep", keep)
    (writer.option("version", version) if version else writer).mode("append").save()
    return current(root)


def published(spark: SparkSession, root: str) -> DataFrame:
    """name, document of the current version."""
    told = current(root)
    if told is None or not told["documents"]:
        return spark.createDataFrame([], "name string, document string")
    base = f"{root.rstrip('/')}/{told['version']}"
    files = spark.read.text(base, wholetext=True, recursiveFileLookup=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/part-[0-9a-f]{32}/(.*)$", 1)
    return files.select(F.url_decode(F.regexp_replace(name, r"\+", "%2B")).alias("name"), F.col("value").alias("document"))
