"""Cutting the lineage of tables that a loop works on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in a local session without the setting, as in tests, one of its own."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not given:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is to name a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="cuemill-")
        context.setCheckpointDir(given)
    return given.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
