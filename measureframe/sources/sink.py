"""Result tables on shared storage."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from measureframe.roles import q

# Replacements in names of result files.
NAME_PARTS = {"%": "pcent", "|": "_", ": ": "_"}


def clean_name(name: str) -> str:
    """A table title as a file or directory name."""
    for part, by in NAME_PARTS.items():
        name = name.replace(part, by)
    return re.sub(r"[\s/\\]+", "_", name.strip())


def flat_headers(df: DataFrame) -> DataFrame:
    """Line breaks in headers become spaces (a text header ends at a line break)."""
    return df.select(*[q(c).alias(c.replace("\n", " ")) for c in df.columns])


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
    delimiter: str = "\t",
) -> None:
    """Write as Parquet (default) or as delimited text with a header.

    A task sorts its rows by the columns of ``partition_by``, so they are dealt out in parts of a size that AQE holds to, a big label in several.
    """
    rows = flat_headers(df) if fmt == "csv" else df
    if partition_by:
        rows = rows.hint("rebalance", *[q(c) for c in partition_by])
    writer = rows.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.options(header=True, sep=delimiter).csv(path)
    else:
        writer.format(fmt).save(path)


def write_results(
    results: Mapping[str, DataFrame], directory: str, fmt: str = "csv", prefix: str = "", mode: str = "errorifexists"
) -> dict[str, str]:
    """One directory per table, named after its cleaned title."""
    written = {}
    for name, df in results.items():
        target = f"{directory.rstrip('/')}/{clean_name(prefix + name)}"
        write_table(df, target, fmt, mode=mode, delimiter=",")
        written[name] = target
    return written


def glob_models(spark: SparkSession, pattern: str) -> DataFrame:
    """Model tables below a path pattern such as ``models/AE*``."""
    return spark.read.parquet(pattern)
