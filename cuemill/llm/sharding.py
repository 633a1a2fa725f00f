"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, store, table, text_of, with_field

SHARDS = 8
BUCKET_BYTES = 8 << 20
SEED = 71


def _highest(shards: int, seed: int):
    """The shard with the highest hash of (shard, doc_id): one more shard takes rows only where its own hash is higher."""
    return F.greatest(*[F.struct(F.xxhash64(F.lit(seed), F.lit(k), F.col("doc_id")).alias("h"), F.lit(k).alias("shard")) for k in range(shards)])["shard"]


def shuffled_shards(docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """doc_id, text, size, text_crc32, shard, slot, grown_shard of every document, each shard in random order.

    The law is `key`: doc_id and the number of shards decide the shard.  Pass one scatters the rows of each shard by a
    seeded hash of (doc_id, text) over as many buckets as its bytes need to stay near bucket_bytes; pass two sorts each
    bucket, shuffles it (Fisher-Yates, seeded by seed and bucket) and numbers its rows after the buckets before it.
    Nulls: a null text has size 1 and checksum 0; null doc_ids hash as one key.  Repeated rows are rows of their own; rows
    alike in doc_id and text are interchangeable, and stay in one bucket.  A text longer than bucket_bytes is moved whole, so
    a bucket that holds it is larger by that.  No documents, no rows.  Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = (F.octet_length(text_of()) + 1).cast("long")
    total = rows.agg(F.sum(size)).first()[0] or 0
    each = max(1, -(-total // (shards * bucket_bytes)))
    placed = rows.select(
        "doc_id",
        "text",
        size.alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        _highest(shards, seed).alias("shard"),
        _highest(shards + 1, seed).alias("grown_shard"),
    ).withColumn("bucket", F.col("shard") * each + F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text_crc32", "size"), F.lit(each)))
    schema = with_field(placed, "place", "long")

    def shuffle(key, rows):
        rows = rows.sort_by([("doc_id", "ascending"), ("text_crc32", "ascending"), ("size", "ascending")])
        place = np.random.default_rng([seed, key[0].as_py()]).permutation(rows.num_rows)
        return rows.append_column("place", pa.array(place, pa.int64())).take(pa.array(np.argsort(place)))

    mixed = placed.groupBy("bucket").applyInArrow(shuffle, schema)
    counts = store(placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")), "shard-buckets")
    starts = counts.selectExpr("bucket", "sum(n) over (partition by shard order by bucket) - n as start")
    whole = mixed.join(small(starts, shards * each, 16), "bucket")
    return whole.select("doc_id", "text", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The shuffled shards as Parquet, a folder for each shard, in it a file for each bucket: what pass two has shuffled is
    written where it is, and not dealt again.  Within a file rows are in the order of slot, and buckets follow each other."""
    shuffled_shards(docs, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_sharding(spark, sf_dir) -> DataFrame:
    out = shuffled_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
