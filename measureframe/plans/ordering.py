"""Order statistics that do not depend on a group fitting into one task.

Everything that needs sorted values (quantiles, ranks, empirical distribution
functions, concordance, running values) is built on one step: split the value
axis at cut points, total every slice, carry the totals over the (few) slices
and sort only inside a slice.  The cut points are approximate quantiles of the
*whole* column, so a slice holds no more than its share of all rows, whichever
group those rows belong to.  They decide where the work is done, not the result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from measureframe.roles import as_list, q, with_columns

#: Fewest slices of the value axis, a power of two; more rows make more slices.
SLICES = 16
#: Rows of one group that a single task may sort.
TASK_ROWS = 1_000_000

_SLICE = "_slice"


def task_rows(df: DataFrame) -> int:
    """Row limit of one sorted group; ``spark.measureframe.taskRows`` overrides it."""
    return int(df.sparkSession.conf.get("spark.measureframe.taskRows", str(TASK_ROWS)))


def slice_count(df: DataFrame, rows: int) -> int:
    """A power of two that leaves about a quarter of the row limit to a slice."""
    wanted = max(1, 4 * rows // task_rows(df))
    return max(SLICES, 1 << (wanted - 1).bit_length())


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest group: one pass over the key columns, one row back."""
    counts = df.groupBy(*[q(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.max("_n")).first()[0] or 0


def join_on(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which a missing key equals a missing key; keys appear once."""
    keys = list(keys)
    if not keys:
        raise ValueError("join_on needs at least one key")
    # Renaming the keys keeps both sides apart even when they come from one table.
    renamed = [f"_r{i}" for i in range(len(keys))]
    other = right.select(
        *[q(k).alias(r) for k, r in zip(keys, renamed)],
        *[q(c) for c in right.columns if c not in keys],
    )
    match = reduce(lambda a, b: a & b, [q(k).eqNullSafe(q(r)) for k, r in zip(keys, renamed)])
    return left.join(other, match, how).drop(*renamed)


def join_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Rows next to the result of their group.

    A group result lies by its keys already, so the join would follow in the same stage, with all rows sorted by key, a
    big group in one task.  A stage of its own shows AQE its size: it is broadcast when small, and else a hot key can be split.
    """
    return join_on(df, groups.hint("rebalance"), keys, how)


def cut_points(df: DataFrame, columns: Sequence[str], slices: int = SLICES) -> dict[str, list[float]]:
    """``slices - 1`` approximate quantiles per column, all in one aggregate (one row back)."""
    shares = [i / slices for i in range(1, slices)]
    row = df.agg(*[
        F.percentile_approx(q(c).cast("double"), shares, 20 * slices).alias(f"_{i}")
        for i, c in enumerate(columns)
    ]).first()
    return {c: list(row[i]) if row[i] is not None else [] for i, c in enumerate(columns)}


def slice_of(value: Column, cuts: Sequence[float]) -> Column:
    """Number of cut points below ``value``, by binary search over a constant array."""
    if not cuts:
        return F.lit(0)
    table = F.lit(list(map(float, cuts)))
    step, steps = 1 << (len(cuts).bit_length() - 1), []
    while step:
        steps.append(step)
        step //= 2
    number = value.cast("double")
    return F.aggregate(
        F.lit(steps), F.lit(0),
        lambda pos, s: F.when(F.get(table, pos + s - 1) < number, pos + s).otherwise(pos),
    )


def running_totals(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str,
    values: Sequence[str],
    cuts: Sequence[float] | Column | None = None,
) -> DataFrame:
    """Append ``<v>_upto`` (total of ``v`` up to and including the row) and ``<v>_total``.

    ``df`` has one row per (keys, order).  ``cuts`` are the cut points of ``order``
    (or an expression of the slice number); without them a group is sorted in one task.
    """
    keys = as_list(keys)
    if cuts is None:
        by = W.partitionBy(*[q(k) for k in keys]) if keys else W.partitionBy(F.lit(0))
        upto = by.orderBy(q(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
        return with_columns(df, {
            **{f"{v}_upto": F.sum(q(v)).over(upto) for v in values},
            **{f"{v}_total": F.sum(q(v)).over(by) for v in values},
        })
    spot = cuts if isinstance(cuts, Column) else slice_of(q(order), cuts)
    sliced = df.withColumn(_SLICE, spot)
    inside = keys + [_SLICE]
    sums = sliced.groupBy(*[q(k) for k in inside]).agg(*[F.sum(q(v)).alias(v) for v in values])
    # One row per group and slice from here on.
    by = W.partitionBy(*[q(k) for k in keys]) if keys else W.partitionBy(F.lit(0))
    before = by.orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *[q(k) for k in inside],
        *[F.coalesce(F.sum(q(v)).over(before), F.lit(0)).alias(f"{v}_before") for v in values],
        *[F.sum(q(v)).over(by).alias(f"{v}_total") for v in values],
    )
    local = W.partitionBy(*[q(k) for k in inside]).orderBy(q(order)).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    joined = join_on(sliced, offsets, inside)
    return joined.select(
        *[q(c) for c in df.columns],
        *[(F.sum(q(v)).over(local) + q(f"{v}_before")).alias(f"{v}_upto") for v in values],
        *[q(f"{v}_total") for v in values],
    )


def value_counts(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys, ``_feature``, ``_x``, ``_n``): how often each value occurs, missing left out."""
    if len(features) == 1:
        long = df.select(
            *[q(k) for k in keys], F.lit(features[0]).alias("_feature"),
            q(features[0]).cast("double").alias("_x"),
        )
    else:
        wide = df.select(*[q(k) for k in keys], *[q(f).cast("double").alias(f) for f in features])
        long = wide.unpivot([q(k) for k in keys], [q(f) for f in features], "_feature", "_x")
    return (
        long.filter(F.col("_x").isNotNull())
        .groupBy(*[q(k) for k in keys], F.col("_feature"), F.col("_x"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def feature_slices(df: DataFrame, features: Sequence[str], rows: int) -> Column:
    """Slice number of ``_x`` for the feature named in ``_feature``."""
    cuts = cut_points(df, features, slice_count(df, rows))
    spot = F.lit(0)
    for f in features:
        spot = F.when(F.col("_feature") == f, slice_of(F.col("_x"), cuts[f])).otherwise(spot)
    return spot


def group_quantiles(
    df: DataFrame,
    keys: str | Sequence[str],
    features: Sequence[str],
    probs: Sequence[float],
    name: Callable[[str, float], str],
    method: str = "exact",
    largest: int | None = None,
) -> DataFrame:
    """Exact, linearly interpolated quantiles of each feature in each group.

    Groups of a size one task can hold use the built-in aggregate.  Beyond it, the
    values are counted, and the order statistics are found from running counts, so
    that no group is gathered anywhere.  ``method="approx"`` uses a sketch instead.
    """
    keys = as_list(keys)
    by = [q(k) for k in keys]
    if method == "approx":
        return df.groupBy(*by).agg(*[
            F.percentile_approx(q(f), float(p)).alias(name(f, p)) for f in features for p in probs
        ])
    if method != "exact":
        raise ValueError("method must be 'exact' or 'approx'")
    if largest is None:
        largest = largest_group(df, keys)
    if not fits_task(df, largest, features):
        return counted_quantiles(df, keys, features, probs, name, largest)
    # One aggregate per feature yields all its quantiles.
    shares = F.lit([float(p) for p in probs])
    packed = df.groupBy(*by).agg(*[F.percentile(q(f), shares).alias(f"_q{i}") for i, f in enumerate(features)])
    return packed.select(*by, *[
        F.get(F.col(f"_q{i}"), F.lit(j)).alias(name(f, p))
        for i, f in enumerate(features) for j, p in enumerate(probs)
    ])


def fits_task(df: DataFrame, rows: int, features: Sequence[str]) -> bool:
    """Whether one task can hold the distinct values of all features of a group."""
    return rows * len(features) <= task_rows(df)


def counted_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    probs: Sequence[float],
    name: Callable[[str, float], str],
    largest: int,
) -> DataFrame:
    """Quantiles from running counts of the distinct values."""
    by = [q(k) for k in keys]
    counts = value_counts(df, keys, features)
    slices = feature_slices(df, features, largest) if largest > task_rows(df) else None
    run = running_totals(counts, [*keys, "_feature"], "_x", ["_n"], slices)
    first, last = F.col("_n_upto") - F.col("_n"), F.col("_n_upto") - 1
    spots = {p: F.lit(float(p)) * (F.col("_n_total") - 1) for p in probs}
    covers = {
        (p, side): (first <= at) & (at <= last)
        for p, h in spots.items()
        for side, at in (("lo", F.floor(h)), ("hi", F.ceil(h)))
    }
    picked = run.filter(reduce(lambda a, b: a | b, covers.values()))
    stats = picked.groupBy(*by, F.col("_feature")).agg(
        F.max("_n_total").alias("_n_total"),
        *[
            F.max(F.when(hit, F.col("_x"))).alias(f"_{side}{list(probs).index(p)}")
            for (p, side), hit in covers.items()
        ],
    )
    value = {}
    for i, (p, h) in enumerate(spots.items()):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        value[p] = F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (h - F.floor(h)))
    found = stats.groupBy(*by).agg(*[
        F.max(F.when(F.col("_feature") == f, value[p])).alias(name(f, p))
        for f in features for p in probs
    ])
    if not keys:
        return found
    # Groups in which every value is missing have no counts; they keep their row.
    return join_on(df.select(*by).distinct(), found, keys, "left")
