"""Change along a series: columns of one row, or rows of one group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from measureframe.plans.ordering import (
    cut_points, join_on, largest_group, slice_count, slice_of, task_rows,
)
from measureframe.roles import SEP, as_list, categories, drop_missing, join_name, q

#: Outputs of ``series_analysis`` that are on by default.
DEFAULT_PARTS = ("min", "max", "range", "delta", "delta_min", "delta_max", "delta_sum", "delta_cum", "delta_norm")
ALL_PARTS = (
    "min", "max", "range", "mean", "median",
    "delta", "delta_cum", "delta_norm", "delta_min", "delta_max", "delta_sum",
)


def series_names(features: Sequence[str], sep: str = SEP) -> tuple[str, list[str]]:
    """Common name parts of the features, and what is particular to each point."""
    parts = [f.split(sep) for f in features]
    common = [p for p in parts[0] if all(p in other for other in parts)]
    points = [sep.join(p for p in one if p not in common) for one in parts]
    return sep.join(common), points


def _extreme(fn, cols: Sequence[Column]) -> Column:
    return fn(*cols) if len(cols) > 1 else cols[0]


def _sum_present(cols: Sequence[Column]) -> Column:
    """Sum without missing values; 0 when all are missing."""
    return sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))


def _mean_present(cols: Sequence[Column]) -> Column:
    count = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    return F.try_divide(_sum_present(cols), count)


def _median_present(cols: Sequence[Column]) -> Column:
    values = F.sort_array(F.array_compact(F.array(*cols)))
    n = F.size(values)
    low, high = F.floor((n - 1) / 2).cast("int"), F.ceil((n - 1) / 2).cast("int")
    return (F.get(values, low) + F.get(values, high)) / F.lit(2.0)


def series_analysis(
    df: DataFrame,
    features: Sequence[str],
    parts: Sequence[str] = DEFAULT_PARTS,
    merge_input: bool = False,
    sep: str = SEP,
) -> DataFrame:
    """Per row: extremes, steps, cumulative and normalised steps over ordered columns.

    A step is missing when either end is; the running sum skips a missing step; a
    normalised step is its share of the total change (missing when that is zero).
    """
    feats = list(features)
    label, points = series_names(feats, sep)
    steps = list(zip(points, points[1:]))

    def name(text: str) -> str:
        return join_name(label, text, sep=sep)

    base = df.select(
        *[q(c) for c in categories(df)],
        *([q(f) for f in feats] if merge_input else []),
        *[q(f).cast("double").alias(f"_v{i}") for i, f in enumerate(feats)],
    )
    values = [F.col(f"_v{i}") for i in range(len(feats))]
    out = base.select("*", *[
        (values[i + 1] - values[i]).alias(f"_d{i + 1}") for i in range(len(steps))
    ])
    deltas = [F.col(f"_d{i + 1}") for i in range(len(steps))]
    running, totals = F.lit(0.0), []
    for d in deltas:
        running = running + F.coalesce(d, F.lit(0.0))
        totals.append(F.when(d.isNotNull(), running))
    total = totals[-1] if totals else F.lit(None).cast("double")

    made: list[Column] = []
    low, high = _extreme(F.least, values), _extreme(F.greatest, values)
    singles = {
        "min": ("Series min", low), "max": ("Series max", high),
        "range": ("Series max-min", high - low), "mean": ("Series mean", _mean_present(values)),
        "median": ("Series median", _median_present(values)),
    }
    made += [col.alias(name(text)) for key, (text, col) in singles.items() if key in parts]
    if "delta" in parts:
        made += [d.alias(name(f"delta {a}:{b}")) for (a, b), d in zip(steps, deltas)]
    if "delta_cum" in parts:
        made += [t.alias(name(f"cumulative delta {points[0]}:{b}")) for (_, b), t in zip(steps, totals)]
    if "delta_norm" in parts:
        made += [
            F.try_divide(d, total).alias(name(f"normalized delta {a}:{b}"))
            for (a, b), d in zip(steps, deltas)
        ]
    if deltas:
        tails = {
            "delta_min": ("delta min", _extreme(F.least, deltas)),
            "delta_max": ("delta max", _extreme(F.greatest, deltas)),
            "delta_sum": ("delta sum", _sum_present(deltas)),
        }
        made += [col.alias(name(text)) for key, (text, col) in tails.items() if key in parts]
    kept = [c for c in out.columns if not c.startswith(("_v", "_d"))]
    return out.select(*[q(c) for c in kept], *made)


def series_analysis_long(
    df: DataFrame,
    grouping: str | Sequence[str],
    step: str,
    value: str,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """The same along rows: one row per (group, step) with its step and running change.

    Repeated steps are averaged first.  ``step`` is a number, or a label placed by
    ``order``.  A long series is cut into slices of steps; the last value and the
    totals are carried from slice to slice.
    """
    keys = as_list(grouping)
    by = [q(k) for k in keys]
    place = q(step).cast("double") if order is None else F.nullif(
        F.array_position(F.lit(list(order)), q(step)), F.lit(0)
    ).cast("double")
    placed = df.select(*by, q(step), place.alias("_at"), q(value).cast("double").alias("_v"))
    points = (
        drop_missing(placed, [*keys, "_at"]).groupBy(*by, q(step), F.col("_at")).agg(F.avg("_v").alias("_v"))
    )
    cuts: list[float] = []
    # With an order, a series has no more points than there are labels.
    if order is None and (largest := largest_group(df, keys)) > task_rows(df):
        cuts = cut_points(df, [step], slice_count(df, largest))[step]
    points = points.withColumn("_slice", slice_of(F.col("_at"), cuts))
    whole = W.partitionBy(*by)
    part = W.partitionBy(*by, F.col("_slice"))
    # What each slice hands on: its last point.
    ends = points.groupBy(*by, F.col("_slice")).agg(
        F.max_by(F.struct("_v"), "_at").alias("_end"), F.lit(True).alias("_any")
    )
    handed = ends.select(
        *by, F.col("_slice"), F.lag("_end").over(whole.orderBy("_slice")).alias("_from")
    )
    linked = join_on(points, handed, [*keys, "_slice"])
    previous = F.coalesce(
        F.lag(F.struct("_v")).over(part.orderBy("_at")), F.col("_from")
    )
    stepped = linked.select(
        *by, q(step), "_at", "_slice", "_v", (F.col("_v") - previous["_v"]).alias("_delta")
    )
    sums = stepped.groupBy(*by, F.col("_slice")).agg(F.coalesce(F.sum("_delta"), F.lit(0.0)).alias("_sum"))
    before = whole.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(
        *by, F.col("_slice"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_before"),
        F.sum("_sum").over(whole).alias("_change"),
    )
    local = part.orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = F.coalesce(F.sum("_delta").over(local), F.lit(0.0)) + F.col("_before")
    return join_on(stepped, carried, [*keys, "_slice"]).select(
        *by, q(step), F.col("_v").alias(value),
        F.col("_delta").alias("delta"),
        F.when(F.col("_delta").isNotNull(), run).alias("cumulative delta"),
        F.try_divide(F.col("_delta"), F.col("_change")).alias("normalized delta"),
    )
