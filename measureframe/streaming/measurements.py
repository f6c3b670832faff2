"""The import on a growing directory."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from measureframe.operators.filters import RangeFilter, filter_table
from measureframe.operators.summary import categorize
from measureframe.roles import q
from measureframe.sources.text import (
    _PATH, ImportSpec, _cells, _clean_header, _file_uris, _header_groups, _split_regex, _typed, reserved_labels, transform_measurements,
)


def stream_measurements(
    spark: SparkSession,
    path: str,
    columns: Mapping[str, str],
    spec: ImportSpec = ImportSpec(),
    ranges: Sequence[RangeFilter] = (),
    categorize_by: Mapping | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """New files, parsed, renamed, derived, filtered and categorised as in batch.

    ``columns`` (header name to type) are the columns that every file has to have, in any order and
    among others; a file without one of them is an error, as nothing may be guessed.
    A file is one row until its lines are taken apart, so its own header names its cells.  That takes a file
    through one task and ends at 2 GB; ``import_new_files`` reads files of any size in splits.
    The query's checkpoint remembers which files were read.
    """
    reader = (
        spark.readStream.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*{" + ",".join(spec.extensions) + "}")
    )
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    pattern = _split_regex(spec.delimiter)
    clean = lambda c: F.regexp_replace(c, '^["\r]+|["\r]+$', "")
    files = reader.text(path, wholetext=True).select(
        F.split("value", "\r\n|\n|\r").alias("_lines"), F.col("_metadata.file_path").alias(_PATH), F.col("_metadata.file_name").alias("_name")
    ).withColumn("_names", F.transform(F.split(F.get("_lines", F.lit(0)), pattern, -1), clean))
    if spec.exclude:
        files = files.filter(~F.col("_name").isin(list(spec.exclude)))
    absent = F.array_except(F.lit(list(columns)), F.col("_names"))
    unknown = F.raise_error(F.concat(F.lit("columns missing in "), F.col(_PATH), F.lit(": "), F.array_join(absent, ", ")))
    lines = F.when(F.size(absent) == 0, F.expr("slice(_lines, 2, greatest(size(_lines) - 1, 0))")).otherwise(unknown.cast("array<string>"))
    rows = files.select("_names", _PATH, F.explode(lines).alias("_line")).filter(F.trim("_line") != "")
    parts = rows.withColumn("_parts", F.transform(F.split("_line", pattern, -1), clean))
    raw = parts.select(
        *[F.get("_parts", F.array_position("_names", c).cast("int") - 1).alias(c) for c in columns], _PATH)
    table = transform_measurements(_typed(raw, reserved_labels(spec), columns), spec)
    table = filter_table(table, ranges)
    return categorize(table, **categorize_by) if categorize_by else table


def import_new_files(
    spark: SparkSession,
    path: str,
    target: str,
    columns: Mapping[str, str],
    spec: ImportSpec = ImportSpec(),
    ranges: Sequence[RangeFilter] = (),
    categorize_by: Mapping | None = None,
) -> DataFrame:
    """Everything imported so far, after a turn over the files that came since the last call.

    A stream of file names, without contents, knows what is new; its files are then read by the batch reader:
    one small job for the header lines, and the lines in splits, so no file is one value or one task's.
    Rows are as those of ``stream_measurements``.  A turn counts when its names are written behind its rows;
    one that was broken off is read again in whole.
    """
    names = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(spec.extensions) + "}").load(path).select("path")
    )
    if spec.exclude:
        names = names.filter(~F.element_at(F.split("path", "/"), -1).isin(list(spec.exclude)))
    run = (
        names.writeStream.format("parquet").option("path", f"{target}/names").option("checkpointLocation", f"{target}/log")
        .outputMode("append").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    done = _written(spark, f"{target}/done", "path string, turn int")
    turns = [r["turn"] for r in done.select("turn").distinct().collect()]
    new = _written(spark, f"{target}/names", "path string").join(done, "path", "left_anti").distinct().orderBy("path")
    new = [r["path"] for r in new.toLocalIterator()]

    def shaped(raw: DataFrame) -> DataFrame:
        table = transform_measurements(_typed(raw, reserved_labels(spec), columns), spec, files=_file_uris(spark, new) if new else None)
        table = filter_table(table, ranges)
        return categorize(table, **categorize_by) if categorize_by else table

    raw = spark.createDataFrame([], ", ".join("`" + c.replace("`", "``") + "` string" for c in [*columns, _PATH]))
    if new:
        for header, members in _header_groups(spark, new, spec.shared_header):
            have = _clean_header(re.split(_split_regex(spec.delimiter), header))
            absent = [c for c in columns if c not in have]
            if absent:
                raise ValueError(f"columns missing in {members[0]}: {', '.join(absent)}")
            raw = raw.unionByName(_cells(spark, header, members, spec.delimiter).select(*[q(c) for c in columns], _PATH))
        turns.append(max(turns, default=-1) + 1)
        shaped(raw).write.mode("overwrite").parquet(f"{target}/rows/turn={turns[-1]}")
        spark.createDataFrame([(p,) for p in new], "path string").coalesce(1).write.mode("overwrite").parquet(f"{target}/done/turn={turns[-1]}")
    return spark.read.parquet(*[f"{target}/rows/turn={n}" for n in sorted(turns)]) if turns else shaped(raw)


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, without rows before its first is written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
