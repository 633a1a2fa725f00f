"""Stored files as listings, through any file system that Spark reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.names import artifact_stem
from ..functions.uris import SCHEMES


def listing(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, name, parent, mtime, size of the files under root; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    files = (reader.option("recursiveFileLookup", "true") if recursive else reader).load(root)
    return files.select("path", F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.regexp_replace("path", "/[^/]*$", "").alias("parent"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def zip_files(spark: SparkSession, root: str, min_age_seconds: float = 60, now: str | None = None) -> DataFrame:
    """ZIP files in the order of their paths that have settled: not changed for min_age_seconds (0: all)."""
    files = listing(spark, root, "*.[zZ][iI][pP]")
    if min_age_seconds > 0:
        at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        files = files.filter((at.cast("double") - F.col("mtime").cast("double")) >= min_age_seconds)
    return files.orderBy("path")


def children(spark: SparkSession, parent: str) -> DataFrame:
    """The files right under parent, by lower-cased name."""
    return listing(spark, parent, recursive=False).orderBy(F.lower("name"), "name")


def remapped(df: DataFrame, internal: str, user: str, column: str = "path") -> DataFrame:
    """Paths under the internal root as paths under the user's."""
    inside = F.col(column).startswith(internal.rstrip("/") + "/")
    rest = F.substring(F.col(column), F.lit(len(internal.rstrip("/")) + 1), F.length(column))
    return df.withColumn(column, F.when(inside, F.concat(F.lit(user.rstrip("/")), rest)).otherwise(F.col(column)))


def renamed(files: DataFrame, moves: DataFrame) -> DataFrame:
    """files (folder, name) as they are called after moves (old, new): folder and artefacts' stems; others stay."""
    m = moves.select(F.col("old").alias("folder"), F.col("new").alias("_new"))
    out = files.join(m, "folder", "left")
    name = F.when(F.col("_new").isNotNull(), artifact_stem(F.col("name"), F.col("folder"), F.col("_new"))).otherwise(F.col("name"))
    return out.withColumn("name", name).withColumn("folder", F.coalesce("_new", "folder")).drop("_new")


class Providers:
    """Readers by scheme: local paths here, others injected as functions (spark, value) -> listing."""

    def __init__(self, readers: dict[str, Callable[[SparkSession, str], DataFrame]] | None = None):
        self.readers = {"local": listing} | (readers or {})

    def read(self, spark: SparkSession, uri: str) -> DataFrame:
        scheme, _, value = uri.partition("://")
        provider = SCHEMES.get(scheme.lower())
        if provider is None or provider not in self.readers:
            raise ValueError(f"no provider for {uri!r}")
        return self.readers[provider](spark, value)


def missing_artefacts(required: DataFrame, files: DataFrame) -> DataFrame:
    """folder, name of required artefacts that are not stored."""
    return required.join(files, ["folder", "name"], "left_anti")


def broken_models(expected: DataFrame, files: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """model, fault, name: the first reason why each model can't be used; fault null if it can.

    expected: model, pos, name, and size and sha256 of a model file, or most_size and json_keys (array) of a small one.
    files: model, name, size, sha256, is_symlink, and content of small files.  Missing files come before all else; then, file
    by file, link, size, checksum; then small files' link, size, JSON, object, keys; then the budget for all of them.
    """
    out = expected.join(files.select("model", "name", *[F.col(c).alias(f"_{c}") for c in ("size", "sha256", "is_symlink", "content")]), ["model", "name"], "left")
    small = F.col("sha256").isNull()
    body = F.col("_content").cast("string")
    parsed = F.try_parse_json(F.when(F.is_valid_utf8(body), body))
    keys = F.coalesce("json_keys", F.array().cast("array<string>"))
    kind = F.schema_of_variant(parsed)
    wanting = F.exists(keys, lambda k: ~F.array_contains(F.coalesce(F.json_object_keys(body), F.array().cast("array<string>")), k))
    why = lambda at, fault: F.struct(F.lit(at).alias("at"), F.lit(fault).alias("fault"))
    fault = (
        F.when(F.col("_size").isNull(), why(0, "missing"))
        .when(F.col("_is_symlink") & ~small, why(1, "symlink"))
        .when(~small & (F.col("_size") != F.col("size")), why(1, "size"))
        .when(~small & (F.col("_sha256") != F.col("sha256")), why(1, "checksum"))
        .when(F.col("_is_symlink"), why(2, "symlink"))
        .when(small & (F.col("_size") > F.col("most_size")), why(2, "size"))
        .when(small & parsed.isNull(), why(2, "json"))
        .when(small & (F.size(keys) > 0) & ~F.startswith(kind, F.lit("OBJECT")), why(2, "object"))
        .when(small & wanting, why(2, "keys"))
    )
    whole = out.withColumn("_fault", fault).groupBy("model").agg(F.min_by(F.struct("_fault.fault", "name"), F.when(F.col("_fault").isNotNull(), F.struct("_fault.at", "pos"))).alias("first"), F.sum("_size").alias("_all"))
    over = F.lit(False) if most_bytes is None else F.col("_all") > most_bytes
    return whole.select("model", F.when(F.col("first").isNotNull(), F.col("first.fault")).when(over, "budget").alias("fault"), F.col("first.name").alias("name"))


class ListingSource(DataSource):
    """spark.read.format("cuemill_listing").option("root", uri).load(): path, name, parent, mtime, size of files on any file
    system that pyarrow opens; option pattern filters names.  Each folder right under the root is one partition."""

    @classmethod
    def name(cls):
        return "cuemill_listing"

    def schema(self):
        return "path string, name string, parent string, mtime timestamp, size long"

    def reader(self, schema):
        return _ListingReader(self.options.get("root"), self.options.get("pattern", "*"))


class _ListingReader(DataSourceReader):
    def __init__(self, root, pattern):
        if not root:
            raise ValueError("option root is needed")
        self.root, self.pattern = root if "://" in root else f"file://{root}", pattern

    def _found(self, path, recursive):
        from pyarrow import fs as pafs

        system, root = pafs.FileSystem.from_uri(self.root)
        return system.get_file_info(pafs.FileSelector(path or root, recursive=recursive))

    def partitions(self):
        folders = [f.path for f in self._found(None, False) if not f.is_file]
        return [InputPartition(None), *map(InputPartition, folders)]

    def read(self, partition):
        from fnmatch import fnmatchcase

        for f in self._found(partition.value, partition.value is not None):
            if f.is_file and fnmatchcase(f.base_name, self.pattern):
                yield f.path, f.base_name, f.path.rsplit("/", 1)[0], f.mtime, f.size


def register_listing(spark: SparkSession) -> None:
    spark.dataSource.register(ListingSource)
