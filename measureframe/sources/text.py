"""Delimited text files as measurement tables.

Files are listed by Spark's own file index.  Files with the same header line are
read together in one scan, so the plan has as many branches as there are
different headers, and no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from measureframe.functions.derive import DERIVED, derive
from measureframe.operators.columns import (
    DROPPED_PARTS, HEADER_PARTS, combine_categories, drop_columns, rename_columns, reorder_columns,
)
from measureframe.roles import (
    RESERVED_CATEGORIES, as_list, mark_categories, nan_to_null, q,
)
from measureframe.sources.paths import parse_path, path_patterns, plain_path

EXTENSIONS = (".txt", ".csv")
PREVIEW_ROWS = 200
_PATH, _URI = "_source_path", "_source_uri"
#: Most files whose labels are broadcast.
BROADCAST_FILES = 100_000
# Cells read as missing.
MISSING_TEXT = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
)


_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))$"


@dataclass(frozen=True)
class ImportSpec:
    """What to read and what to do with it."""

    delimiter: str = "\t"
    parser: str | Mapping[str, str] = "none"
    extensions: Sequence[str] = EXTENSIONS
    exclude: Sequence[str] = ()
    rename: Mapping[str, str] = field(default_factory=lambda: dict(HEADER_PARTS))
    drop: Sequence[str] = DROPPED_PARTS
    combos: Sequence[Sequence[str]] | None = ()
    derived: Sequence = DERIVED
    types: Mapping[str, str] | None = None
    shared_header: bool = False


def list_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    extensions: Sequence[str] = EXTENSIONS,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Every file below ``paths`` with ``name``, ``length`` and whether it is to be read."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(as_list(paths))
        .select(F.col("path"), F.col("length"))
        .withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))
    )
    wanted = F.lit(False)
    for ext in extensions:
        wanted = wanted | F.col("name").endswith(ext)
    if exclude:
        wanted = wanted & ~F.col("name").isin(list(exclude))
    return listing.withColumn("added", wanted)


def discover_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    extensions: Sequence[str] = EXTENSIONS,
    exclude: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Files to read (sorted by path), and the counts of added and skipped files."""
    listing = list_files(spark, paths, extensions, exclude)
    files = listing.filter("added").select("path", "name", "length").distinct().orderBy("path")
    counts = listing.distinct().agg(
        F.count_if("added").alias("added"), F.count_if(~F.col("added")).alias("skipped")
    )
    return files, counts


def _split_regex(delimiter: str) -> str:
    """Every character of ``delimiter`` separates cells."""
    return "[" + "".join("\\" + c if c in "\\]^-[&" else c for c in delimiter) + "]"


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(_literal(paths)).select(
        F.col("value"), F.col("_metadata.file_path").alias(_PATH),
        F.col("_metadata.file_block_start").alias("_start"),
    )


def _header_groups(spark: SparkSession, paths: list[str], shared: bool) -> list[tuple[str, list[str]]]:
    """(header line, its files).  Only one line per file reaches the driver, next to its path."""
    if not paths:
        return []
    if shared:
        first = spark.read.text(_literal(paths[:1])).head()
        return [(first["value"], paths)] if first else []
    # The first line of a file is in the split that starts at 0; the id grows along a scan task.
    heads = (
        _lines(spark, paths)
        .filter(F.col("_start") == 0)
        .withColumn("_at", F.monotonically_increasing_id())
        .groupBy(_PATH)
        .agg(F.min_by("value", "_at").alias("header"))
    )
    groups: dict[str, list[str]] = {}
    for row in heads.orderBy(_PATH).toLocalIterator():
        groups.setdefault(row["header"], []).append(unquote(row[_PATH]))
    return list(groups.items())


def _cells(spark: SparkSession, header: str, paths: list[str], delimiter: str) -> DataFrame:
    """String cells of files that share ``header``, and the path of each row."""
    if len(delimiter) == 1:
        names = _clean_header(header.split(delimiter))
        schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
        rows = (
            spark.read.schema(schema)
            .options(header=True, sep=delimiter, mode="PERMISSIVE", nullValue="")
            .csv(_literal(paths))
        )
        return rows.select(*[q(n) for n in names], F.col("_metadata.file_path").alias(_PATH))
    pattern = _split_regex(delimiter)
    names = _clean_header(re.split(pattern, header))
    # Spark's CSV reader drops the first line of each file, wherever the splits lie; a separator
    # that no line has leaves the lines whole.
    whole = {"header": True, "sep": "\u0001", "quote": ""}
    rows = spark.read.schema("value string").options(**whole).csv(_literal(paths)).select(
        "value", F.col("_metadata.file_path").alias(_PATH)).filter(F.trim("value") != "")
    parts = rows.select(F.split("value", pattern, -1).alias("_parts"), _PATH)
    return parts.select(*[F.get("_parts", F.lit(i)).alias(n) for i, n in enumerate(names)], _PATH)


def _literal(paths: Sequence[str]) -> list[str]:
    """Paths for a reader, which would take brackets and stars for a pattern."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]


def _clean_header(names: Sequence[str]) -> list[str]:
    out: list[str] = []
    for i, name in enumerate(names):
        text = name.strip('"\r') or f"Unnamed: {i}"
        k, unique = 0, text
        while unique in out:
            k += 1
            unique = f"{text}.{k}"
        out.append(unique)
    return out


def _present(col: Column) -> Column:
    return F.when(~F.trim(col).isin(*MISSING_TEXT), col)


def _number(cell: Column, kind: str = "double") -> Column:
    """The cell as a number; missing for text, also where a cast would see one (``1d``, ``2F``)."""
    text = F.trim(cell)
    return F.when(text.rlike(_NUMBER), text.try_cast(kind))


def _numeric_columns(df: DataFrame, candidates: list[str]) -> set[str]:
    """Candidates without any cell that is neither missing nor a number (one pass, one row)."""
    if not candidates:
        return set()
    bad = df.agg(*[
        F.count_if(~F.trim(q(c)).rlike(_NUMBER) & ~F.trim(q(c)).isin(*MISSING_TEXT)).alias(f"_{i}")
        for i, c in enumerate(candidates)
    ]).first()
    return {c for i, c in enumerate(candidates) if bad[i] == 0}


def _typed(df: DataFrame, labels: set[str], types: Mapping[str, str] | None) -> DataFrame:
    others = [c for c in df.columns if c != _PATH and c not in labels]
    if types is None:
        types = {c: "double" for c in _numeric_columns(df, others)}
    made = []
    for c in df.columns:
        if c == _PATH:
            made.append(q(c))
            continue
        kind = types.get(c, "string") if c not in labels else "string"
        numeric = kind in ("double", "float", "int", "bigint", "long", "smallint", "tinyint")
        # No text that stands for a missing cell reads as a number.
        cell = _number(q(c), kind) if numeric else _present(q(c))
        made.append((cell if numeric or kind == "string" else F.trim(cell).try_cast(kind)).alias(c))
    return df.select(*made)


def _file_uris(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files as readers name them to their rows, by one listing without contents."""
    listing = spark.read.format("binaryFile").load(_literal(paths)).select(F.col("_metadata.file_path").alias(_PATH))
    return [r[_PATH] for r in listing.distinct().toLocalIterator()]


def _path_labels(df: DataFrame, spec: ImportSpec, path: str, files: list[str] | None) -> DataFrame:
    """Labels from the path instead of it: once for each of the ``files``, or by row where they are not known."""
    if files is None or spec.parser == "none":
        return parse_path(df.withColumn(path, plain_path(F.col(path))), path, spec.parser).drop(path)
    named = df.sparkSession.createDataFrame([(f, f) for f in files], f"{_URI} string, {_PATH} string")
    labels = parse_path(named.withColumn(_PATH, plain_path(F.col(_PATH))), _PATH, spec.parser).drop(_PATH)
    made = [c for c in labels.columns if c != _URI]
    kept = [c for c in df.columns if c not in made]
    # The driver has the files of the readers anyway; so many of them that they are better shuffled also spread the rows.
    few = F.broadcast(labels) if len(files) <= BROADCAST_FILES else labels
    joined = df.select(*[q(c) for c in kept]).join(few, F.col(path) == F.col(_URI), "left")
    return joined.select(*[q(c) for c in kept if c != path], *[q(c) for c in made])


def transform_measurements(df: DataFrame, spec: ImportSpec, path: str = _PATH, files: list[str] | None = None) -> DataFrame:
    """Path labels, renaming, dropping, combining, ordering, deriving.

    With ``files``, all paths that rows can have, labels come from one row for each file; everything else is row by row.
    """
    df = _path_labels(df, spec, path, files)
    df = drop_columns(rename_columns(df, spec.rename), spec.drop)
    labels = reserved_labels(spec)
    df = mark_categories(df, [c for c in df.columns if c in labels])
    if spec.combos is None or len(spec.combos) > 0:
        df = combine_categories(df, spec.combos)
    return derive(reorder_columns(nan_to_null(df)), spec.derived)


def reserved_labels(spec: ImportSpec) -> set[str]:
    return {*RESERVED_CATEGORIES, *path_patterns(spec.parser), "Directory", "File"}


def read_measurements(
    spark: SparkSession,
    paths: str | Sequence[str],
    spec: ImportSpec = ImportSpec(),
    rows_per_file: int | None = None,
) -> DataFrame:
    """All files below ``paths`` as one measurement table.

    ``spec.types`` (``{column: type}``) skips the pass that finds out which columns
    are numbers; ``spec.shared_header`` skips the pass that reads the headers.
    """
    files, _ = discover_files(spark, paths, spec.extensions, spec.exclude)
    listed = [r["path"] for r in files.toLocalIterator()]
    groups = _header_groups(spark, listed, spec.shared_header)
    if not groups:
        raise FileNotFoundError(f"no readable files below {paths}")
    table: DataFrame | None = None
    for header, members in groups:
        part = _cells(spark, header, members, spec.delimiter)
        table = part if table is None else table.unionByName(part, allowMissingColumns=True)
    if rows_per_file is not None:
        table = first_rows(table, rows_per_file)
    return transform_measurements(_typed(table, reserved_labels(spec), spec.types), spec, files=_file_uris(spark, listed))


def first_rows(df: DataFrame, n: int, path: str = _PATH) -> DataFrame:
    """The first ``n`` rows of every file (group limit before the shuffle)."""
    at = F.monotonically_increasing_id()
    order = W.partitionBy(path).orderBy("_at")
    return (
        df.withColumn("_at", at)
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= n)
        .drop("_at", "_n")
    )


def preview(
    spark: SparkSession, paths: str | Sequence[str], spec: ImportSpec = ImportSpec(), n: int = PREVIEW_ROWS
) -> DataFrame:
    """The import with at most ``n`` rows of each file."""
    return read_measurements(spark, paths, spec, rows_per_file=n)


def open_table(
    spark: SparkSession,
    path: str,
    delimiter: str = "\t",
    reader: Callable[[SparkSession, str], DataFrame] | None = None,
) -> DataFrame:
    """One file as it is: no path labels, no preprocessing."""
    if reader is not None:
        return reader(spark, path)
    df = spark.read.options(header=True, sep=delimiter, inferSchema=True).csv(path)
    return nan_to_null(mark_categories(df, [c for c in df.columns if c in RESERVED_CATEGORIES]))
