"""Merging, stacking, zipping and splitting tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from measureframe.plans.ordering import join_groups, join_on
from measureframe.roles import (
    as_category, as_list, categories, features, q, unique_name,
)


def merge_tables(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Equi-join on all shared categories; a missing label matches a missing label.

    Categories come first; other columns on both sides get ``_x`` and ``_y``.
    """
    if how not in ("left", "right", "inner", "outer"):
        raise ValueError(f"unknown kind of merge: {how}")
    right_cats = categories(right)
    keys = [c for c in categories(left) if c in right_cats]
    if not keys:
        raise ValueError("the tables share no category")
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    lnames = {c: c + "_x" if c in clash else c for c in left.columns}
    rnames = {c: c + "_y" if c in clash else c for c in right.columns}
    a = left.select(*[q(c).alias("_l_" + c) for c in left.columns])
    b = right.select(*[q(c).alias("_r_" + c) for c in right.columns])
    match = reduce(lambda x, y: x & y, [q("_l_" + k).eqNullSafe(q("_r_" + k)) for k in keys])

    lcats = [c for c in categories(left) if c not in keys]
    rcats = [c for c in right_cats if c not in keys]

    def shaped(df: DataFrame, lside: bool, rside: bool) -> DataFrame:
        def lcol(c: str) -> Column:
            return q("_l_" + c) if lside else F.lit(None).cast(left.schema[c].dataType)

        def rcol(c: str) -> Column:
            return q("_r_" + c) if rside else F.lit(None).cast(right.schema[c].dataType)

        def key(c: str) -> Column:
            if lside and rside:
                return q("_r_" + c) if how == "right" else q("_l_" + c)
            return q("_l_" + c) if lside else q("_r_" + c)

        return df.select(
            *[as_category(key(c), c) for c in keys],
            *[as_category(lcol(c), lnames[c]) for c in lcats],
            *[as_category(rcol(c), rnames[c]) for c in rcats],
            *[lcol(c).alias(lnames[c]) for c in left.columns if c not in keys and c not in lcats],
            *[rcol(c).alias(rnames[c]) for c in right.columns if c not in keys and c not in rcats],
        )

    if how != "outer":
        return shaped(a.join(b, match, how), True, True)
    # A skewed key can be split in a left and in an anti join, but not in a full join.  The anti join needs a key once.
    present = a.select(*[q("_l_" + k) for k in keys]).distinct()
    return shaped(a.join(b, match, "left"), True, True).unionByName(
        shaped(b.join(present, match, "left_anti"), False, True)
    )


def concat_rows(tables: Mapping[str, DataFrame], source: str = "Source") -> DataFrame:
    """Stack tables: union of the columns, the table's name as first category."""
    cats: list[str] = []
    parts = []
    for name, df in tables.items():
        cats += [c for c in categories(df) if c not in cats]
        rest = [q(c) for c in df.columns if c != source]
        parts.append(df.select(as_category(F.lit(name), source), *rest))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    ordered = [source, *[c for c in cats if c != source]]
    ordered += [c for c in stacked.columns if c not in ordered]
    return stacked.select(*[
        as_category(q(c), c) if c == source or c in cats else q(c) for c in ordered
    ])


def _keyed_once(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows, with an error for a key that comes again; grouping serves the join that follows."""
    others = [c for c in df.columns if c not in keys]
    one = df.groupBy(*[q(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("_rows"), F.first(F.struct(*[q(c) for c in others], F.lit(0).alias("_none"))).alias("_row"))
    failed = F.raise_error(F.concat(F.lit("a key is not unique: "), F.to_json(F.struct(*[q(k) for k in keys]))))
    row = F.when(F.col("_rows") == 1, F.col("_row")).otherwise(failed)
    return one.select(*[q(k) for k in keys], row.alias("_row")).select(*[
        q(c) if c in keys else F.col("_row").getField(c).alias(c, metadata=df.schema[c].metadata) for c in df.columns
    ])


def zip_columns(
    tables: Sequence[DataFrame], on: str | Sequence[str], numbers_only: bool = True
) -> DataFrame:
    """Tables side by side, aligned on a key that is unique in each of them.

    A key that occurs twice in a table is an error when the rows are made.
    """
    keys = as_list(on)
    tables = [_keyed_once(t, keys) for t in tables]
    out = tables[0]
    for other in tables[1:]:
        others = [
            c for c in other.columns
            if c not in keys and (not numbers_only or c in features(other))
        ]
        names: dict[str, str] = {}
        for c in others:
            names[c] = unique_name(c, [*out.columns, *names.values()])
        right = other.select(
            *[q(k).alias(f"_r_{k}") for k in keys], *[q(c).alias(n) for c, n in names.items()]
        )
        match = reduce(lambda a, b: a & b, [q(k).eqNullSafe(q(f"_r_{k}")) for k in keys])
        left_cols = [c for c in out.columns if c not in keys]
        out = out.withColumn("_left", F.lit(True)).join(right, match, "full").select(
            *[F.when(F.col("_left"), q(k)).otherwise(q(f"_r_{k}")).alias(k) for k in keys],
            *[q(c) for c in left_cols], *[q(n) for n in names.values()],
        )
    return out


def join_labels(df: DataFrame, labels: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Attach one result row per group to the rows of the group."""
    return join_groups(df, labels, as_list(keys))


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(columns)) if columns else df.dropDuplicates()


def except_rows(df: DataFrame, taken: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``taken``; genuine duplicates stay."""
    keys = as_list(on)
    return join_on(df, taken.select(*[q(k) for k in keys]).distinct(), keys, "left_anti")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(q(column)).distinct()


def split_table(df: DataFrame, by: str | Sequence[str]) -> dict[tuple, DataFrame]:
    """One lazy table per label combination, each a filter of ``df``.

    The distinct labels reach the driver, as they name the tables; ``split_to`` (one directory
    per label, in one pass) is the way to split by many labels.
    """
    keys = as_list(by)
    labels = df.select(*[q(k) for k in keys]).distinct().toLocalIterator()
    return {
        tuple(row): df.filter(
            reduce(lambda a, b: a & b, [q(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, row)])
        )
        for row in sorted(labels, key=lambda r: tuple((v is None, str(v)) for v in r))
    }


def split_to(df: DataFrame, by: str | Sequence[str], path: str, mode: str = "errorifexists") -> None:
    """Write one directory per label combination; readers prune by label."""
    df.write.mode(mode).partitionBy(*as_list(by)).parquet(path)


def label_pairs(values: Sequence[str]) -> list[tuple[str, str]]:
    """Unordered pairs of the labels of one category."""
    return list(combinations(values, 2))
