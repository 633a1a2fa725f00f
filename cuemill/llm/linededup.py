"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, lean, partitions, shared_dir, store, table

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2
BROADCAST_KEYS = 200_000
SPLITS = 64  # parts of the documents that hold one repeated line, where the lines are too many to be broadcast
_LOWEST = -(2**63)


def _keys(text: str, min_chars: int) -> tuple[list[str], list[bytes | None]]:
    """The lines of a text, and the hash of each key (line stripped, A-Z lower-cased) that is long enough."""
    lines = text.split("\n")
    keys = [k if len(k := line.strip(SPACE)) >= min_chars else None for line in lines]
    return lines, [k if k is None else xxhash.xxh3_128_digest(k.encode().lower()) for k in keys]


class LineRuns:
    """Levels of sorted runs (key, n_docs, max_doc) in the shared folder, all dealt alike: bucketed by key and sorted in each bucket.

    The batches come from the largest doc_ids down.  A batch is merge anti-joined with the runs: keys that none of them has
    are new, and only their rows say which document keeps the line (max_doc); of keys that a run has, the batch adds a
    count, and no document.  So a key has one max_doc in all the runs together - if a key were taken for new twice, the
    later, smaller document would stand (_merge).  When a level has `fanout` runs they are merged into one of the next level.
    Joins and merges find equal keys in equal buckets: nothing is shuffled but the batches, once.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels, self.buckets = spark, fanout, [[]], partitions(spark)
        self.tables: list[str] = []

    def bucketed(self, df: DataFrame, name: str, by: str | None = None) -> str:
        """Writes df, dealt by key already, as a table of one file for each bucket (and value of `by`); its name."""
        full = f"cuemill_{name}_{uuid.uuid4().hex}"
        writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(self.spark)}/cuemill/{full}")
        (writer.partitionBy(by) if by else writer).bucketBy(self.buckets, "key").sortBy("key").saveAsTable(full)
        self.tables.append(full)
        return full

    def dealt(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.buckets, "key")

    @staticmethod
    def _merge(older: DataFrame, newer: DataFrame) -> DataFrame:
        """Two runs as one: counts add up; the one max_doc that a key has stays."""
        a, b = older.alias("a"), newer.hint("merge").alias("b")
        count = F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))
        return a.join(b, F.col("a.key") == F.col("b.key"), "full").select(F.coalesce("a.key", "b.key").alias("key"), count.alias("n_docs"), F.coalesce("b.max_doc", "a.max_doc").alias("max_doc"))

    def runs(self) -> list[DataFrame]:
        """All runs, older ones first: a higher level holds what came before a lower one."""
        return [self.spark.table(r) for level in reversed(self.levels) for r in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys that are in no run: merge anti-joins, run by run."""
        for run in self.runs():
            keys = keys.join(run.select("key").hint("merge"), "key", "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Adds a batch: key, doc_id, each pair once, all doc_ids below those of earlier batches."""
        own = self.dealt(keys.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc")))
        self.add_counted(self.spark.table(self.bucketed(own, "batch")))

    def add_counted(self, own: DataFrame) -> None:
        """Adds a batch of key, n_docs, max_doc, read from a bucketed table."""
        run = own
        if self.runs():
            new = self.unseen(own).select(F.col("key").alias("_new"), F.col("max_doc").alias("_doc")).hint("merge")
            run = own.drop("max_doc").join(new, F.col("key") == F.col("_new"), "left").select("key", "n_docs", F.col("_doc").alias("max_doc"))
        self.levels[0].append(self.bucketed(run, "run_0"))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            merged = reduce(self._merge, [self.spark.table(r) for r in self.levels[level]])
            self.levels[level + 1].append(self.bucketed(merged, f"run_{level + 1}"))
            self.levels[level] = []
            level += 1

    def totals(self) -> DataFrame:
        """key, n_docs, max_doc over all runs."""
        return reduce(self._merge, self.runs())

    def close(self) -> None:
        """Forgets the tables; their files stay for the owner of the shared folder."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = []


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, doc_id) of each long line, once for each row of documents; a null doc_id stands below all others."""

    @lean
    def find(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            keys, of = [], []
            for d, text in zip(ids, texts, strict=True):
                found = {k for k in _keys(text or "", min_chars)[1] if k}
                keys += found
                of += [_LOWEST if d is None else d] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(of, pa.int64())], names=["key", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, "key binary, doc_id long")


def repeated_keys(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """key, max_doc of the line keys that min_docs documents or more hold, found batch by batch through LineRuns.

    Counts are combined in each task before the one shuffle by key, so a line that a third of all documents hold weighs as
    much as there are tasks.  Where doc_ids repeat, the pairs are made distinct first.
    """
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("doc_id"))
    n, distinct = ids.agg(F.count("*"), F.count_distinct("doc_id")).first()
    cuts = ids.agg(F.percentile_approx("doc_id", [k / batches for k in range(batches - 1, 0, -1)] or [0.0])).first()[0]
    cuts = sorted(set(cuts or []) if batches > 1 else [], reverse=True)
    pairs = line_keys(docs, min_chars)
    if n > distinct:
        pairs = pairs.distinct()
    batch = sum((F.when(F.col("doc_id") <= c, 1).otherwise(0) for c in cuts), F.lit(0))
    counted = pairs.groupBy("key", batch.alias("batch")).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
    runs = LineRuns(spark, fanout)
    try:
        whole = spark.table(runs.bucketed(runs.dealt(counted), "batches", "batch"))
        for k in range(len(cuts) + 1):
            runs.add_counted(whole.filter(F.col("batch") == k).drop("batch"))
        return store(runs.totals().filter(F.col("n_docs") >= min_docs).select("key", "max_doc"), "line-repeated")
    finally:
        runs.close()


def met_in_parts(pairs: DataFrame, repeated: DataFrame, splits: int = SPLITS) -> DataFrame:
    """pairs (key, doc_id) with the max_doc of their key.  The documents of a line meet it in `splits` parts, by their ids, so a
    line of a third of all documents is not one task's."""
    parts = repeated.withColumn("_part", F.explode(F.expr(f"sequence(0, {splits - 1})")))
    cut = pairs.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(splits)).cast("int"))
    return cut.join(parts.hint("merge"), ["key", "_part"]).drop("_part")


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, broadcast_keys: int = BROADCAST_KEYS
) -> DataFrame:
    """docs with text lacking its repeated lines, n_lines (before) and n_dropped.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased.  A key of min_chars code points or more that
    min_docs documents (doc_ids) or more hold keeps its lines only in the largest of them.  The documents come in batches
    of falling doc_ids; each is merge anti-joined with the runs so far and adds its own.  The repeated keys then meet the
    lines by broadcast while there are at most broadcast_keys of them, else by joins on key, in parts, and doc_id.
    No documents, no rows.  Nulls: a null text is one empty line and comes back empty; a null doc_id is a document below all others.  Rows with
    one doc_id are one document.  Texts of any length are read whole.  Other columns stay; clashing ones are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    repeated = repeated_keys(docs, min_chars, min_docs, batches, fanout)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    names = docs.columns

    def rewrite(b, drops):
        texts, n_lines, n_dropped = [], [], []
        for text, drop in zip(b.column(b.schema.get_field_index("text")).to_pylist(), drops, strict=True):
            lines, found = _keys(text or "", min_chars)
            kept = [line for line, k in zip(lines, found, strict=True) if k is None or not drop(k)]
            texts.append("\n".join(kept))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        cols = [pa.array(texts, pa.string()) if n == "text" else b.column(b.schema.get_field_index(n)) for n in names]
        return pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=schema.names)

    if repeated.count() <= broadcast_keys:
        held = spark.sparkContext.broadcast({bytes(r[0]): r[1] for r in repeated.select("key", "max_doc").collect()})

        @lean
        def by_broadcast(batches):
            largest = held.value
            for b in batches:
                ids = b.column(b.schema.get_field_index("doc_id")).to_pylist()
                yield rewrite(b, [lambda k, d=_LOWEST if d is None else d: largest.get(k, d) != d for d in ids])

        return docs.mapInArrow(by_broadcast, schema)

    drops = met_in_parts(line_keys(docs, min_chars).distinct(), repeated).filter("doc_id <> max_doc").groupBy("doc_id").agg(F.collect_list("key").alias("_drop"))
    whole = docs.join(drops.withColumnRenamed("doc_id", "_doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)) == F.col("_doc"), "left").drop("_doc")

    @lean
    def by_join(batches):
        for b in batches:
            yield rewrite(b, [set(x or ()).__contains__ for x in b.column(b.schema.get_field_index("_drop")).to_pylist()])

    return whole.mapInArrow(by_join, schema)


def op3_line_dedup(spark, sf_dir) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k, max(doc_id) AS m FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.*, coalesce(keyed.doc_id <> hot.m, false) AS gone FROM keyed LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
