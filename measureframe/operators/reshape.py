"""Pivot, unpivot, sort, category order."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from measureframe.roles import (
    SEP, as_category, as_list, categories, drop_missing, features as feature_columns, join_name, q,
    unique_name, value_order,
)


def _take_labels(df: DataFrame, keys: Sequence[str]) -> list:
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} distinct labels in {list(keys)} (spark.sql.pivotMaxValues)")
    return rows


def _sorted_labels(df: DataFrame, keys: Sequence[str], labels: Iterable[tuple]) -> list[tuple]:
    orders = [value_order(df, k) or [] for k in keys]

    def place(label: tuple) -> tuple:
        return tuple(
            (o.index(v), "") if v in o else (len(o), v if isinstance(v, (int, float)) else str(v))
            for v, o in zip(label, orders)
        )

    return sorted(labels, key=place)


def label_values(df: DataFrame, keys: Sequence[str]) -> list[tuple]:
    """Sorted distinct label combinations, at most ``spark.sql.pivotMaxValues`` of them."""
    found = _take_labels(drop_missing(df.select(*[q(k) for k in keys]), keys).distinct(), keys)
    return _sorted_labels(df, keys, [tuple(r) for r in found])


def pivot_table(
    df: DataFrame,
    columns: str | Sequence[str],
    features: str | Sequence[str],
    values: Sequence[str] | Sequence[tuple] | None = None,
    index: Sequence[str] | None = None,
    sep: str = SEP,
) -> DataFrame:
    """Mean of each feature per label of ``columns``; one row per other categories.

    Give ``values`` to save the job that finds the labels.  Rows and columns in
    which every mean is missing are left out (columns only when found here).
    """
    keys, feats = as_list(columns), as_list(features)
    if index is None:
        index = [c for c in categories(df) if c not in keys]
    data = drop_missing(df, [*index, *keys])
    # Means per cell first, so that the second step handles one row per cell.
    means = data.groupBy(*[q(c) for c in [*index, *keys]]).agg(*[F.avg(q(f)).alias(f) for f in feats])
    if values is None:
        present = _filled_labels(data, keys, feats)
    else:
        labels = [v if isinstance(v, tuple) else (v,) for v in values]
        present = [(f, v) for f in feats for v in labels]
    cells = {
        join_name(f, *map(str, v), sep=sep): F.max(F.when(_is_label(keys, v), q(f)))
        for f, v in present
    }
    if not cells:
        return data.select(*[q(c) for c in index]).limit(0)
    wide = means.groupBy(*[q(c) for c in index]).agg(*[c.alias(n) for n, c in cells.items()])
    return wide.filter(reduce(lambda a, b: a | b, [q(n).isNotNull() for n in cells]))


def _is_label(keys: Sequence[str], label: tuple):
    return reduce(lambda a, b: a & b, [q(k) == F.lit(v) for k, v in zip(keys, label)])


def _filled_labels(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> list[tuple[str, tuple]]:
    """(feature, label) with at least one value, in label order, from one small aggregate."""
    filled = df.groupBy(*[q(k) for k in keys]).agg(*[F.count(q(f)).alias(f) for f in features])
    rows = _take_labels(filled, keys)
    names = [*keys, *features]
    counts = {tuple(r[: len(keys)]): dict(zip(names, r)) for r in rows}
    return [(f, v) for f in features for v in _sorted_labels(df, keys, counts) if counts[v][f] > 0]


def unpivot_table(
    df: DataFrame,
    features: Sequence[str],
    category_name: str = "Category",
    feature_name: str = "Feature",
    prefix: str | None = None,
    sep: str = SEP,
) -> DataFrame:
    """One row per feature: the categories, the feature's name and its value.

    ``prefix`` (default: ``feature_name``) plus separator is removed from the
    names; other separators become ``|``.
    """
    cats = categories(df)
    name_col = unique_name(category_name, cats)
    value_col = unique_name(feature_name, [*cats, name_col])
    wide = df.select(*[q(c) for c in cats], *[q(f).cast("double").alias(f) for f in features])
    long = wide.unpivot([q(c) for c in cats], [q(f) for f in features], name_col, value_col)
    head = (feature_name if prefix is None else prefix) + sep
    # The names are few and known, so cleaning them is a lookup, not work per row.
    clean = {f: f.removeprefix(head).replace(sep, "|") for f in features}
    changed = {k: v for k, v in clean.items() if k != v}
    label = q(name_col)
    for old, new in changed.items():
        label = F.when(q(name_col) == old, F.lit(new)).otherwise(label)
    return long.select(
        *[q(c) for c in cats], as_category(label, name_col), q(value_col)
    )


def _order_by(by: str | Sequence[str], ascending: bool) -> list[Column]:
    return [q(c).asc_nulls_last() if ascending else q(c).desc_nulls_last() for c in as_list(by)]


def sort_rows(df: DataFrame, by: str | Sequence[str], ascending: bool = True) -> DataFrame:
    """Sort with missing values last in either direction."""
    return _total_sort(df, _order_by(by, ascending))


def _total_sort(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Global sort in which rows with equal keys can go to different tasks.

    Ties are broken by a hash of the row, and copies of one row by the partition they
    come from: both are the same when a task is rerun, so that no row is lost.
    """
    tied = df.select(
        "*", F.xxhash64(*[q(c) for c in df.columns]).alias("_tie"), F.spark_partition_id().alias("_from")
    )
    return tied.orderBy(*order, "_tie", "_from").drop("_tie", "_from")


def top_rows(df: DataFrame, by: str | Sequence[str], n: int, ascending: bool = False) -> DataFrame:
    """The first ``n`` sorted rows, kept per partition before they are merged."""
    return df.orderBy(*_order_by(by, ascending)).limit(n)


def category_rank(column: str, order: Sequence[str]):
    """0-based place of a label in ``order``; missing for an unlisted label."""
    place = F.array_position(F.lit(list(order)), q(column))
    return F.when(place > 0, (place - 1).cast("int"))


def order_categories(
    df: DataFrame,
    orders: Mapping[str, Sequence[str]],
    category_order: Sequence[str] | None = None,
    append_unseen: bool = False,
    sort: bool = True,
) -> DataFrame:
    """Give categories a value order, put them first, sort the rows by them.

    Labels outside the order become missing, unless ``append_unseen`` puts them
    at its end.
    """
    full = {c: list(v) for c, v in orders.items()}
    if append_unseen:
        for c in full:
            full[c] += [v for (v,) in label_values(df, [c]) if v not in full[c]]
    head = list(category_order or categories(df))
    cols = {
        c: as_category(F.when(q(c).isin(v), q(c)), c, v) for c, v in full.items()
    }
    ordered = [*head, *[c for c in df.columns if c not in head]]
    out = df.select(*[cols.get(c, q(c)) for c in ordered])
    if sort:
        out = _total_sort(out, [
            category_rank(c, full[c]).asc_nulls_last() if c in full else q(c).asc_nulls_last()
            for c in head
        ])
    return out


def numeric_features(df: DataFrame, chosen: str | Sequence[str] = "ALL") -> list[str]:
    return feature_columns(df) if chosen == "ALL" else as_list(chosen)
