"""Written tables in the shared folder, and a few helpers on rows and batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=4)
def _own_folder(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='llm-')}"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session that names none gets a folder of its own.

    On a cluster a folder of one machine would hold a part of the rows only, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = _own_folder(spark.sparkContext.applicationId)
    return named.rstrip("/")


#: Paths written since the innermost open scope began, for each open scope.
_scopes: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read back.

    This cuts the lineage, and a lost executor costs a read, not a rerun.  The files
    stay until the scope ends that they were written in, or the folder is cleared.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove tables that nothing reads any more."""
    context = spark.sparkContext
    for path in paths:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written inside are deleted at the end, but for paths that are taken off the list."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield paths
    finally:
        _scopes[:] = [other for other in _scopes if other is not paths]
        delete(spark, paths)


_stage: list[str] = []


def next_stage(spark: SparkSession) -> None:
    """Delete what the stage before wrote for itself; its result has been written and is all that is read on."""
    if any(paths is _stage for paths in _scopes):
        delete(spark, _stage)
        _stage.clear()
    else:
        _scopes.insert(0, _stage)


def settled_in(spark: SparkSession, build, name: str) -> DataFrame:
    """``build()`` written, and every table that was written on the way deleted."""
    with scope(spark):
        df = build()
        path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def short(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, as texts may be long; Spark bounds a batch's bytes itself."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def shard_count(rows: int, per_shard: int) -> int:
    return max(1, -(-rows // per_shard))


def shard_of(shards: int, *columns: Column) -> Column:
    """A shard by hash; the same row always falls into the same one."""
    return F.pmod(F.xxhash64(*columns), F.lit(shards)).cast("int")
