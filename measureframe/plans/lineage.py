"""Rows that an iterative fit reads many times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel


def checkpoint_folder(spark: SparkSession) -> str | None:
    """The shared folder that ``spark.checkpoint.dir`` names, if any."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def settled(df: DataFrame) -> DataFrame:
    """Persisted rows behind a reliable checkpoint, on all cores.

    A lost executor then costs a read of the checkpoint, not a rerun of the plan, and
    every pass sees the same partitions.  Without a checkpoint folder the rows are
    only persisted.  Fewer partitions than cores (a small table in one file) are
    spread out; a large table has more and is left as it lies.
    """
    spark = df.sparkSession
    if checkpoint_folder(spark) is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    rows = df.checkpoint()
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)
    return rows.persist(StorageLevel.MEMORY_AND_DISK)
