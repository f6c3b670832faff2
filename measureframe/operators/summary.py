"""Group summaries, means with errors, change relative to a reference."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from measureframe.functions import registry
from measureframe.operators.reshape import label_values, numeric_features, pivot_table
from measureframe.plans.ordering import group_quantiles, join_groups, join_on
from measureframe.roles import (
    SEP, as_category, as_list, categories, drop_missing, join_name, q,
)

AGGREGATES = (
    "count", "min", "max", "mean", "std", "sem", "median", "25 percentile", "75 percentile", "sum",
)
_QUANTILES = {"median": 0.5, "25 percentile": 0.25, "75 percentile": 0.75}


def _simple(agg: str, f: str) -> Column:
    x = q(f)
    return {
        "count": lambda: F.count(x),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "mean": lambda: F.avg(x),
        "std": lambda: F.stddev_samp(x),
        "sem": lambda: F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x))),
        "sum": lambda: F.coalesce(F.sum(x), F.lit(0.0)),
    }[agg]()


def summarize(
    df: DataFrame,
    grouping: str | Sequence[str] = (),
    features: str | Sequence[str] = "ALL",
    aggs: Sequence[str] = AGGREGATES,
    sep: str = SEP,
    quantiles: str = "exact",
    keep_null_groups: bool = False,
) -> DataFrame:
    """Chosen aggregates of all features per observed group, in one table.

    ``aggs`` may also name registered aggregate functions (``Column -> Column``).
    """
    keys, feats = as_list(grouping), numeric_features(df, features)
    feats = [f for f in feats if f not in keys]
    custom = [a for a in aggs if a in registry.names("aggregate")]
    unknown = [a for a in aggs if a not in AGGREGATES and a not in custom]
    if unknown:
        raise ValueError(f"unknown aggregates: {unknown}")
    data = df.select(*[q(c) for c in [*keys, *feats]])
    if keys and not keep_null_groups:
        data = drop_missing(data, keys)
    simple = [a for a in aggs if a not in _QUANTILES and a not in custom]
    ordered = [a for a in aggs if a in _QUANTILES]
    by = [q(k) for k in keys]
    text = [c for c in feats if isinstance(data.schema[c].dataType, T.StringType)]
    plain = [
        _simple(a, f).alias(join_name(f, a, sep=sep))
        for f in feats for a in simple if f not in text or a in ("count", "min", "max")
    ]
    numbers = [f for f in feats if f not in text]
    probs = [_QUANTILES[a] for a in ordered]
    labels = {p: a for a, p in _QUANTILES.items()}

    def title(f: str, p: float) -> str:
        return join_name(f, labels[p], sep=sep)

    # One aggregate per kind: next to the others, the plain ones would lose their code generation.
    parts = [data.groupBy(*by).agg(*plain)] if plain else []
    if ordered and numbers:
        parts.append(group_quantiles(data, keys, numbers, probs, title, quantiles))
    if custom and numbers:
        parts.append(data.groupBy(*by).agg(*[
            registry.lookup("aggregate", a)(q(f)).alias(join_name(f, a, sep=sep)) for f in numbers for a in custom
        ]))
    if not parts:
        raise ValueError("nothing to aggregate")
    out = reduce(lambda a, b: _side_by_side(a, b, keys), parts)
    cols = [join_name(f, a, sep=sep) for f in feats for a in aggs]
    return out.select(*by, *[q(c) for c in cols if c in out.columns])


def _side_by_side(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two results of one grouping in one table (each one row without a grouping)."""
    if keys:
        return join_on(left, right, keys)
    row = right.select(F.struct(*[q(c) for c in right.columns]).alias("_row")).scalar()
    return left.withColumn("_row", row).select(
        *[q(c) for c in left.columns], *[F.col("_row")[c].alias(c) for c in right.columns]
    )


def summary_tables(
    df: DataFrame, grouping: str | Sequence[str], features: str | Sequence[str] = "ALL",
    aggs: Sequence[str] = AGGREGATES, sep: str = SEP,
) -> dict[str, DataFrame]:
    """One table per feature: projections of the wide summary."""
    keys = as_list(grouping)
    wide = summarize(df, keys, features, aggs, sep)
    return {
        f: wide.select(*[q(k) for k in keys], *[q(join_name(f, a, sep=sep)) for a in aggs])
        for f in numeric_features(df, features) if f not in keys
    }


def group_counts(df: DataFrame, grouping: str | Sequence[str], name: str = "count") -> DataFrame:
    keys = as_list(grouping)
    return drop_missing(df, keys).groupBy(*[q(k) for k in keys]).agg(F.count(F.lit(1)).alias(name))


def column_limits(
    df: DataFrame, features: Sequence[str], factor: float | None = None, sep: str = SEP
) -> DataFrame:
    """Smallest and largest value; with a ``factor``, axis limits that include zero."""
    lows = {f: F.min(q(f)) for f in features}
    highs = {f: F.max(q(f)) for f in features}
    if factor is not None:
        lows = {f: F.least(F.lit(0.0), c) * F.lit(factor) for f, c in lows.items()}
        highs = {f: F.greatest(F.lit(0.0), c) * F.lit(factor) for f, c in highs.items()}
    return df.agg(
        *[c.alias(join_name(f, "min", sep=sep)) for f, c in lows.items()],
        *[c.alias(join_name(f, "max", sep=sep)) for f, c in highs.items()],
    )


def mean_error(
    df: DataFrame,
    grouping: str | Sequence[str],
    features: str | Sequence[str],
    error_type: str = "sem",
    bar_type: str = "single",
    error_bar: str = "+/-",
    dropna: bool = True,
    sep: str = SEP,
) -> DataFrame:
    """Mean and error per group, as a bar chart shows them.

    Any ``error_type`` but ``std`` is the standard error.  ``100% stacked`` scales
    means and errors to the sum of the absolute means.  ``error_bar`` ``+`` adds a
    lower error of zero; ``None`` leaves errors out.
    """
    keys, feats = as_list(grouping), as_list(features)
    data = df.select(*[q(c) for c in [*keys, *feats]])
    if keys:
        data = drop_missing(data, keys)
        if dropna:
            data = drop_missing(data, feats)
    kind = "std" if error_type == "std" else "sem"
    stats = data.groupBy(*[q(k) for k in keys]).agg(*[
        _simple(a, f).alias(f"_{a}{i}") for i, f in enumerate(feats) for a in ("mean", kind)
    ])
    scale: Column | None = None
    if bar_type == "100% stacked":
        scale = sum((F.coalesce(F.abs(F.col(f"_mean{i}")), F.lit(0.0)) for i in range(len(feats))), F.lit(0.0))

    def scaled(col: Column) -> Column:
        return col if scale is None else F.try_divide(col, scale) * F.lit(100.0)

    out = [q(k) for k in keys]
    for i, f in enumerate(feats):
        out.append(scaled(F.col(f"_mean{i}")).alias(join_name(f, "mean", sep=sep)))
        if error_bar != "None":
            if error_bar == "+":
                out.append(
                    F.when(F.col(f"_{kind}{i}").isNotNull(), F.lit(0.0)).alias(join_name(f, "lower error", sep=sep))
                )
            out.append(scaled(F.col(f"_{kind}{i}")).alias(join_name(f, "error", sep=sep)))
    return stats.select(*out)


def bar_table(
    df: DataFrame, grouping: Sequence[str], feature: str, values: Sequence[str] | None = None,
    error_type: str = "sem", sep: str = SEP,
) -> DataFrame:
    """Single-bar layout: the first category spread over columns."""
    first, rest = grouping[0], list(grouping[1:])
    stats = mean_error(df, grouping, feature, error_type, sep=sep)
    parts = [join_name(feature, "mean", sep=sep), join_name(feature, "error", sep=sep)]
    labels = [(v,) for v in values] if values is not None else label_values(df, [first])
    return pivot_table(stats, first, parts, labels, index=rest, sep=sep)


def relative_change(
    df: DataFrame,
    grouping: str | Sequence[str],
    features: str | Sequence[str],
    reference_group: str,
    reference_value: str,
    method: str = "mean",
    match: str = "grouping",
    quantiles: str = "exact",
) -> DataFrame:
    """Each row divided by the mean or median of the reference rows of its group.

    ``match="grouping"`` compares within ``grouping`` (without the reference
    category), ``match="all"`` within all other categories.
    """
    feats = as_list(features)
    cats = categories(df)
    base = as_list(grouping) if match == "grouping" else cats
    keys = [c for c in base if c != reference_group]
    names = [f"_ref{i}" for i in range(len(feats))]
    reference = df.filter(q(reference_group) == F.lit(reference_value))
    if method == "mean":
        refs = reference.groupBy(*[q(k) for k in keys]).agg(
            *[F.avg(q(f)).alias(n) for f, n in zip(feats, names)]
        )
    elif method == "median":
        at = dict(zip(feats, names))
        refs = group_quantiles(reference, keys, feats, [0.5], lambda f, p: at[f], quantiles)
    else:
        raise ValueError("method must be 'mean' or 'median'")
    if keys:
        # A missing label is no group, so such rows get no reference.
        joined = join_groups(df, drop_missing(refs, keys), keys)
    else:
        one = refs.select(F.struct(*[F.col(n) for n in names]).alias("_s")).scalar()
        joined = df.withColumn("_s", one).select(
            *[q(c) for c in df.columns], *[F.col("_s")[n].alias(n) for n in names]
        )
    return joined.select(
        *[q(c) for c in cats],
        *[F.try_divide(q(f).cast("double"), F.col(n)).alias(f"rel {f}") for f, n in zip(feats, names)],
    )


def group_transform(
    df: DataFrame, grouping: str | Sequence[str], features: str | Sequence[str], agg: str = "mean",
    name: str = "{agg} {feature}",
) -> DataFrame:
    """A group aggregate on every row of its group.

    Aggregate and join back instead of a window: a big group is never gathered.  Without
    grouping all rows are one group; rows with a missing key are in none and get a missing value.
    """
    keys, feats = as_list(grouping), as_list(features)
    if not keys:
        one = group_transform(df.withColumn("_all", F.lit(1)), ["_all"], feats, agg, name)
        return one.drop("_all")
    at = {f: name.format(agg=agg, feature=f) for f in feats}
    if agg in _QUANTILES:
        stats = group_quantiles(df, keys, feats, [_QUANTILES[agg]], lambda f, p: at[f])
    else:
        stats = df.groupBy(*[q(k) for k in keys]).agg(*[_simple(agg, f).alias(n) for f, n in at.items()])
    return join_groups(df, drop_missing(stats, keys), keys)


def right_closed(
    value: Column, edges: Sequence[float], labels: Sequence[str], default: str | None
) -> Column:
    """Label of the bin ``(edge_i, edge_i+1]`` that holds the value."""
    out = F.lit(default).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((value > F.lit(float(low))) & (value <= F.lit(float(high))), F.lit(label)).otherwise(out)
    return out


def categorize(
    df: DataFrame,
    feature: str,
    bins: Sequence[tuple[float, float, str]],
    name: str = "New Cat",
    default: str = "unassigned",
    merge_input: bool = True,
    features: Sequence[str] = (),
) -> DataFrame:
    """New category from value bins ``(low, high, label)``, placed after the others."""
    edges = [low for low, _, _ in bins] + [bins[-1][1]]
    labels = [label for _, _, label in bins]
    cats = [c for c in categories(df) if c != name]
    others = [c for c in (df.columns if merge_input else features) if c not in cats and c != name]
    new = as_category(right_closed(q(feature), edges, labels, default), name, [*labels, default])
    return df.select(*[q(c) for c in cats], new, *[q(c) for c in others])


def change_table(
    df: DataFrame,
    grouping: Sequence[str],
    feature: str,
    normalize_to: Mapping[str, str],
    bins: Sequence[float],
    labels: Sequence[str],
    use_min: bool = False,
    name: str = "Category",
    dropna: bool = True,
    quantiles: str = "exact",
    values: Sequence[tuple] | None = None,
) -> DataFrame:
    """Group medians, their percent change against the reference label, and its bin.

    The first reference category is fixed to its reference label, the others are
    spread over columns and compared with theirs (a single one is spread itself).
    """
    refs = [c for c in grouping if c in normalize_to]
    keys = [c for c in grouping if c not in normalize_to]
    if not refs or not keys:
        raise ValueError("need reference categories and at least one other category in the grouping")
    spread = refs[1:] if len(refs) > 1 else refs
    data = drop_missing(df, list(grouping))
    if len(refs) > 1:
        data = data.filter(q(refs[0]) == F.lit(normalize_to[refs[0]]))
    found = [v if isinstance(v, tuple) else (v,) for v in values] if values is not None else label_values(data, spread)
    reference = tuple(normalize_to[c] for c in spread)
    if reference not in found:
        raise ValueError(f"reference {reference} does not occur")
    medians = group_quantiles(data, [*keys, *spread], [feature], [0.5], lambda f, p: "_median", quantiles)
    title = {v: SEP.join(map(str, v)) for v in found}

    def here(v: tuple) -> Column:
        cond = F.lit(True)
        for c, x in zip(spread, v):
            cond = cond & (q(c) == F.lit(x))
        return cond

    wide = medians.groupBy(*[q(k) for k in keys]).agg(
        *[F.max(F.when(here(v), F.col("_median"))).alias(title[v]) for v in found]
    )
    if dropna:
        wide = drop_missing(wide, [title[v] for v in found])
    base = q(title[reference])
    rel = {
        f"{title[v]} rel %": F.try_divide(q(title[v]) - base, base) * F.lit(100.0)
        for v in found if v != reference
    }
    out = wide.select(*[q(c) for c in wide.columns], *[c.alias(n) for n, c in rel.items()])
    changes = [q(n) for n in rel]
    lowest = F.least(*changes) if len(changes) > 1 else changes[0]
    highest = F.greatest(*changes) if len(changes) > 1 else changes[0]
    out = out.select(
        *[q(c) for c in out.columns], lowest.alias("min rel %"), highest.alias("max rel %")
    )
    binned = [*rel, "min rel %", "max rel %"]
    out = out.select(
        *[q(c) for c in out.columns],
        *[as_category(right_closed(q(c), bins, labels, None), f"Cat {c}") for c in binned],
    )
    chosen = "Cat min rel %" if use_min else "Cat max rel %"
    return out.select(*[q(c) for c in out.columns], as_category(q(chosen), name))


def categorize_by_change(
    df: DataFrame,
    grouping: Sequence[str],
    feature: str,
    normalize_to: Mapping[str, str],
    bins: Sequence[float],
    labels: Sequence[str],
    use_min: bool = False,
    name: str = "Category",
    default: str = "unassigned",
    dropna: bool = True,
    quantiles: str = "exact",
    values: Sequence[tuple] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(change table, rows with the label of their group; ``default`` without one)."""
    table = change_table(
        df, grouping, feature, normalize_to, bins, labels, use_min, name, dropna, quantiles, values
    )
    keys = [c for c in grouping if c not in normalize_to]
    kept = df.select(*[q(c) for c in df.columns if c != name])
    joined = join_groups(kept, table.select(*[q(c) for c in [*keys, name]]), keys)
    cats = [c for c in categories(df) if c != name]
    rows = joined.select(
        *[q(c) for c in cats],
        as_category(F.coalesce(q(name), F.lit(default)), name, [*labels, default]),
        *[q(c) for c in kept.columns if c not in cats],
    )
    return table, rows
