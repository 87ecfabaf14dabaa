"""Checkpoints of training: Parquet tables with a metadata row, put in place by a rename."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession


def save(spark: SparkSession, path: str, merges: DataFrame, state: DataFrame, metadata: dict) -> None:
    """Writes beside the target and renames: a reader never sees half a checkpoint, and the former one is deleted only when the
    new one is in its place (until then it is at ``path``.old)."""
    tmp = f"{path}.tmp"
    merges.coalesce(1).write.mode("overwrite").parquet(f"{tmp}/merges")
    state.write.mode("overwrite").parquet(f"{tmp}/corpus")
    rows = [(k, str(v)) for k, v in (metadata | {"saved_at": time.strftime("%Y-%m-%d %H:%M:%S")}).items()]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").json(f"{tmp}/metadata")
    jvm = spark.sparkContext._jvm
    target, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(tmp)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    fs.delete(aside, True)
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"the former checkpoint can't be moved from {path}")
    if not fs.rename(source, target):
        fs.rename(aside, target)
        raise OSError(f"the checkpoint can't be moved to {path}")
    fs.delete(aside, True)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        path = f"{path}.old"  # a save was cut off between its renames
    metadata = {r["key"]: r["value"] for r in spark.read.json(f"{path}/metadata").collect()}  # a handful of rows
    return spark.read.parquet(f"{path}/merges"), spark.read.parquet(f"{path}/corpus"), metadata
