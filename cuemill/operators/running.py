"""Running sums over keys of any size: ordered blocks, whose totals give the starts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import shared_dir

BROADCAST = 32 << 20
SPLITS = 64


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir and read again, so what follows does not depend on its lineage."""
    path = f"{shared_dir(df.sparkSession)}/cuemill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows, stored, with `block`: the number of a range of (keys, order), in that order.  A key of many rows has several blocks,
    so no task gets all of its rows; a block is what one task of the session's shuffles takes."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    return stored(dealt.withColumn("block", F.spark_partition_id()), name)


def met(rows: DataFrame, few: DataFrame, keys: list[str], n_few: int, row_bytes: int = 96) -> DataFrame:
    """rows joined with the one row that `few` has for some of the keys: by broadcast while that is small; beyond that a key's
    rows meet theirs in SPLITS parts, so no task gets a whole key."""
    if n_few * row_bytes <= BROADCAST:
        return rows.join(F.broadcast(few), keys)
    parts = few.withColumn("_split", F.explode(F.expr(f"sequence(0, {SPLITS - 1})")))
    return rows.withColumn("_split", F.pmod(F.monotonically_increasing_id(), F.lit(SPLITS)).cast("int")).join(parts.hint("merge"), [*keys, "_split"]).drop("_split")


def before_blocks(rows: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """keys, block, out: what `value` sums up to in the blocks of a key before this one.  Sums are combined in each task; a
    key has as many of them as blocks."""
    sums = rows.groupBy(*keys, "block").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    w = Window.partitionBy(*keys).orderBy("block")
    return sums.select(*keys, "block", (F.sum("_sum").over(w) - F.col("_sum")).cast("long").alias(out))


def in_block(keys: list[str], order: list[str], value: Column) -> Column:
    """The running sum of value within a key's rows of one block, up to and with each row."""
    return F.sum(value).over(Window.partitionBy(*keys, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).cast("long")
