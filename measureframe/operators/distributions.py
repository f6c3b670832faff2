"""Histograms, densities, box statistics, confidence intervals and point tables."""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from measureframe.operators.reshape import label_values
from measureframe.operators.summary import _side_by_side, mean_error
from measureframe.plans.ordering import group_quantiles, join_groups, join_on
from measureframe.roles import as_list, drop_missing, inf_to_null, pick_features, q

BINS = 100
GRID = 200
#: Values whose kernels are evaluated at once, and weights that are drawn at once.
_KERNEL_ROWS, _DRAWS = 4096, 2_000_000
#: Weights drawn in one step, cells of the unit interval in a guide, guides that a task keeps.
_BLOCK, _CELLS, _GUIDES = 16_384, 1 << 16, 64

# Workers get these helpers by value, so they need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _group_title(keys: Sequence[str]) -> Column:
    if not keys:
        return F.lit("all")
    return F.concat_ws(", ", *[q(k).cast("string") for k in keys])


def histogram_long(
    df: DataFrame,
    feature: str,
    grouping: str | Sequence[str] = (),
    bins: int = BINS,
    low: float | None = None,
    high: float | None = None,
    stacked: bool = False,
    cumulative: bool = False,
    density: bool = False,
) -> DataFrame:
    """(group, bin, edges, count, share): every bin of every group, empty ones too.

    Equal-width bins, the last one closed.  Shares add up to 100 per group (over all
    groups when stacked); values outside the range count in the total only.
    """
    keys = as_list(grouping)
    data = df.select(*[q(k) for k in keys], q(feature).cast("double").alias("_x"))
    if keys:
        data = drop_missing(data, keys)
    if low is None or high is None:
        # Both limits stay inside the query as a one-row subquery.
        ends = df.agg(F.struct(
            F.min(q(feature)).cast("double").alias("lo"), F.max(q(feature)).cast("double").alias("hi")
        )).scalar()
    lo = F.lit(float(low)) if low is not None else ends["lo"]
    hi = F.lit(float(high)) if high is not None else ends["hi"]
    # A single value gets a range of width 1 around it.
    lo, hi = F.when(lo == hi, lo - 0.5).otherwise(lo), F.when(lo == hi, hi + 0.5).otherwise(hi)
    x = F.col("_x")
    spot = F.least(F.lit(bins - 1), F.floor(F.try_divide(x - lo, hi - lo) * F.lit(bins))).cast("int")
    data = data.select(
        *[q(k) for k in keys], F.when(x.between(lo, hi), spot).alias("_bin"), x.isNotNull().cast("long").alias("_ok")
    )
    counts = data.groupBy(*[q(k) for k in keys], F.col("_bin")).agg(F.sum("_ok").alias("_n"))
    group = W.partitionBy(*[q(k) for k in keys]) if keys else W.partitionBy(F.lit(0))
    # From here on there are at most bins + 1 rows per group.
    totals = counts.groupBy(*[q(k) for k in keys]).agg(
        F.sum("_n").alias("_total"), F.map_from_entries(F.collect_list(
            F.when(F.col("_bin").isNotNull(), F.struct("_bin", "_n"))
        )).alias("_map"),
    )
    total = F.col("_total")
    if stacked:
        total = df.agg(F.count(q(feature))).scalar()
    grid = totals.select(
        *[q(k) for k in keys], total.alias("_total"), "_map",
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
    ).select(
        *[q(k) for k in keys], "bin", "_total",
        F.coalesce(F.try_element_at("_map", F.col("bin")), F.lit(0)).cast("long").alias("count"),
    )
    step = (hi - lo) / F.lit(bins)
    if density:
        # Area 1 over the values inside the range.
        inside = grid.agg(F.sum("count")).scalar() if stacked else F.sum("count").over(group)
        share = F.try_divide(F.col("count").cast("double"), inside * step)
    else:
        share = F.try_divide(F.col("count") * F.lit(100.0), F.col("_total"))
    grid = grid.select("*", share.alias("share"))
    if cumulative:
        upto = group.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
        width = step if density else F.lit(1.0)
        grid = grid.withColumn("share", F.sum("share").over(upto) * width)
    return grid.select(
        *[q(k) for k in keys], _group_title(keys).alias("group"), "bin",
        (lo + step * F.col("bin")).alias("bin edge low"),
        F.when(F.col("bin") == bins - 1, hi).otherwise(lo + step * (F.col("bin") + 1)).alias("bin edge high"),
        "count", "share",
    )


def histogram(
    df: DataFrame,
    feature: str,
    grouping: str | Sequence[str] = (),
    settings: Mapping[str, tuple[float, float, int]] | None = None,
    groups: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """Bin edges and one ``<group> [rel %]`` column per group."""
    keys = as_list(grouping)
    if settings and feature in settings:
        low, high, bins = settings[feature]
        options = {"low": low, "high": high, "bins": bins, **options}
    long = histogram_long(df, feature, keys, **options)
    if not keys:
        groups = ["all"]
    elif groups is None:
        groups = [", ".join(map(str, v)) for v in label_values(df.filter(q(feature).isNotNull()), keys)]
    # Stacked bars: each group stands on the ones before it.
    below = {g: list(groups[: i + 1]) if options.get("stacked") else [g] for i, g in enumerate(groups)}
    return long.groupBy("bin", "bin edge low", "bin edge high").agg(*[
        F.sum(F.when(F.col("group").isin(below[g]), F.col("share"))).alias(f"{g} [rel %]") for g in groups
    ]).drop("bin")


def kde_long(
    df: DataFrame,
    feature: str,
    grouping: str | Sequence[str] = (),
    points: int = GRID,
    bandwidth: float | None = None,
    cut: float = 3.0,
) -> DataFrame:
    """(group, i, x, y): Gaussian kernel density on an even grid.

    Equal values are counted before anything is evaluated; each (group, value,
    count) adds to the grid of its group, and the sums are combined map-side.
    Groups without spread have no density and are left out.
    """
    keys = as_list(grouping)
    by = [q(k) for k in keys]
    data = df.select(*by, q(feature).cast("double").alias("_x"))
    data = inf_to_null(data, ["_x"]).filter(F.col("_x").isNotNull())
    if keys:
        data = drop_missing(data, keys)
    ends = data.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi"))).scalar()
    stats = data.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp("_x").alias("_s"),
        F.min("_x").alias("_min"), F.max("_x").alias("_max"),
    )
    h = F.lit(bandwidth) if bandwidth is not None else F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    stats = stats.filter(F.col("_s") > 0).withColumn("_h", h)
    stats = stats.select(
        *by, "_n", "_h",
        F.greatest(F.col("_min") - F.lit(cut) * F.col("_h"), ends["lo"]).alias("_lo"),
        F.least(F.col("_max") + F.lit(cut) * F.col("_h"), ends["hi"]).alias("_hi"),
    )
    counts = data.groupBy(*by, F.col("_x")).agg(F.count(F.lit(1)).alias("_c"))
    if keys:
        placed = join_on(counts, stats, keys)
    else:
        row = stats.select(F.struct("_n", "_h", "_lo", "_hi").alias("_row")).scalar()
        placed = counts.withColumn("_row", row).filter(F.col("_row").isNotNull()).select(
            "_x", "_c", *[F.col("_row")[c].alias(c) for c in ("_n", "_h", "_lo", "_hi")]
        )
    names = [f"_k{i}" for i in range(len(keys))]
    schema = T.StructType([
        *[T.StructField(n, df.schema[k].dataType) for n, k in zip(names, keys)], T.StructField("i", T.IntegerType()),
        T.StructField("x", T.DoubleType()), T.StructField("_y", T.DoubleType())])
    sums = placed.select(*[q(k).alias(n) for k, n in zip(keys, names)], "_x", "_c", "_n", "_h", "_lo", "_hi").mapInPandas(
        _kernel_sums(names, points), schema)
    found = sums.groupBy(*names, "i").agg(F.max("x").alias("x"), F.sum("_y").alias("y"))
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "i", "x", "y")


def _kernel_sums(names: Sequence[str], points: int):
    """A function on counted values: the density sums of each group that a task has, on the group's grid."""
    share = np.arange(points) / (points - 1) if points > 1 else np.zeros(1)

    def run(batches):
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def rows():
            for label, (x, y) in held.items():
                yield pd.DataFrame({**{n: [v] * points for n, v in zip(names, label)}, "i": np.arange(points, dtype=np.int32), "x": x, "_y": y})
            held.clear()

        for pdf in batches:
            groups = pdf.groupby(list(names), sort=False, dropna=False) if names else [((), pdf)]
            for label, own in groups:
                n, h, low, high = (own[c].iloc[0] for c in ("_n", "_h", "_lo", "_hi"))
                x = low + (high - low) * share
                y = np.zeros(points)
                values, counts = own["_x"].to_numpy(), own["_c"].to_numpy(np.float64)
                for start in range(0, len(values), _KERNEL_ROWS):
                    z = (x[None, :] - values[start:start + _KERNEL_ROWS, None]) / h
                    y += counts[start:start + _KERNEL_ROWS] @ np.exp(-0.5 * z * z)
                y /= n * h * math.sqrt(2 * math.pi)
                key = label if isinstance(label, tuple) else (label,)
                if key in held:
                    held[key][1].__iadd__(y)
                else:
                    held[key] = x, y
                if len(held) > 1000:  # bounded memory, whatever the number of groups
                    yield from rows()
        yield from rows()

    return run


def kde(
    df: DataFrame, feature: str, grouping: str | Sequence[str] = (),
    groups: Sequence[str] | None = None, **options,
) -> DataFrame:
    """``<group>_x`` and ``<group>_y`` columns, one row per grid point ``i``."""
    keys = as_list(grouping)
    long = kde_long(df, feature, keys, **options)
    if not keys:
        return long.select("i", F.col("x").alias("ungrouped_x"), F.col("y").alias("ungrouped_y"))
    if groups is None:
        groups = [", ".join(map(str, v)) for v in label_values(df.filter(q(feature).isNotNull()), keys)]
    title = _group_title(keys)
    return long.groupBy("i").agg(*[
        F.max(F.when(title == g, F.col(c))).alias(f"{g}_{c}") for g in groups for c in ("x", "y")
    ])


def box_stats(
    df: DataFrame, feature: str, grouping: str | Sequence[str] = (), quantiles: str = "exact"
) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 interquartile ranges), outlier count."""
    keys = as_list(grouping)
    by = [q(k) for k in keys]
    data = df.select(*by, q(feature).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    if keys:
        data = drop_missing(data, keys)
    boxes = _boxes(data, keys, quantiles)
    fenced = _with_box(data, boxes, keys)
    inside = F.col("_x").between(F.col("_lowfence"), F.col("_highfence"))
    reach = fenced.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        # A whisker does not start inside the box.
        F.least(F.min(F.when(inside, F.col("_x"))), F.max("q1")).alias("whisker low"),
        F.greatest(F.max(F.when(inside, F.col("_x"))), F.max("q3")).alias("whisker high"),
        F.count_if(~inside).alias("outliers"),
    )
    out = _side_by_side(boxes.drop("_lowfence", "_highfence"), reach, keys)
    return out.select(*by, "n", "q1", "median", "q3", "whisker low", "whisker high", "outliers")


def _boxes(data: DataFrame, keys: Sequence[str], quantiles: str) -> DataFrame:
    names = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    boxes = group_quantiles(data, keys, ["_x"], list(names), lambda f, p: names[p], quantiles)
    reach = (F.col("q3") - F.col("q1")) * F.lit(1.5)
    return boxes.select(
        "*", (F.col("q1") - reach).alias("_lowfence"), (F.col("q3") + reach).alias("_highfence")
    )


def _with_box(data: DataFrame, boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _side_by_side(data, boxes, []) if not keys else join_groups(data, boxes, keys, "inner")


def box_outliers(
    df: DataFrame, feature: str, grouping: str | Sequence[str] = (), quantiles: str = "exact"
) -> DataFrame:
    """The rows beyond the whiskers."""
    keys = as_list(grouping)
    data = df.select(*[q(k) for k in keys], q(feature).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    if keys:
        data = drop_missing(data, keys)
    fenced = _with_box(data, _boxes(data, keys, quantiles), keys)
    beyond = (F.col("_x") < F.col("_lowfence")) | (F.col("_x") > F.col("_highfence"))
    return fenced.filter(beyond).select(*[q(k) for k in keys], F.col("_x").alias(feature))


def violin_stats(
    df: DataFrame, feature: str, grouping: str | Sequence[str] = (), points: int = GRID
) -> dict[str, DataFrame]:
    return {
        "box": box_stats(df, feature, grouping),
        "density": kde_long(df, feature, grouping, points),
    }


def swarm_points(df: DataFrame, feature: str, grouping: str | Sequence[str] = ()) -> DataFrame:
    """The points of a dot plot, all of them."""
    keys = as_list(grouping)
    return drop_missing(df.select(*[q(k) for k in keys], q(feature)), [*keys, feature])


def line_ci(
    df: DataFrame,
    x: str,
    feature: str,
    by: str | Sequence[str] = (),
    ci: float | str = 95,
    method: str = "bootstrap",
    replicates: int = 1000,
    seed: int = 0,
) -> DataFrame:
    """Mean per x (and further categories) with its interval.

    ``ci="sd"`` is mean +- standard deviation.  A number is a percent interval, by
    Poisson bootstrap (``method="bootstrap"``) or from the standard error
    (``"normal"``).
    """
    keys = [x, *as_list(by)]
    data = drop_missing(df.select(*[q(k) for k in keys], q(feature).cast("double").alias("_y")), [*keys, "_y"])
    cols = [q(k) for k in keys]
    stats = data.groupBy(*cols).agg(
        F.avg("_y").alias("mean"), F.stddev_samp("_y").alias("_s"), F.count("_y").alias("n")
    )
    if ci == "sd" or method == "normal":
        if ci == "sd":
            half = F.col("_s")
        else:
            from statistics import NormalDist

            half = F.col("_s") / F.sqrt(F.col("n")) * F.lit(NormalDist().inv_cdf(0.5 + float(ci) / 200))
        return stats.select(
            *cols, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high")
        )
    ends = [(100 - float(ci)) / 200, (100 + float(ci)) / 200]
    boot = _bootstrap_means(data, keys, replicates, seed)
    # One row per replicate and group: the number of rows per group is fixed.
    limits = boot.groupBy(*cols).agg(F.percentile("_mean", F.lit(ends)).alias("_ends"))
    return join_on(stats, limits, keys).select(
        *cols, "n", "mean", F.get("_ends", F.lit(0)).alias("low"), F.get("_ends", F.lit(1)).alias("high")
    )


def poisson_draws(h: np.ndarray, c: np.ndarray, replicates: int, guides: dict | None = None) -> np.ndarray:
    """Poisson(c) weights (rows x replicates): the quantile of a uniform number that the hash and the replicate give.

    ``guides`` keeps the tables of frequent counts from call to call.
    """
    out = np.empty((len(h), replicates))
    steps = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    guides = {} if guides is None else guides
    high = max(1, _BLOCK // replicates)
    # Rows with one count share a table; a count's table spans twelve deviations and more.
    for count, rows in zip(*np.unique(c, return_counts=True)):
        own, guide = np.flatnonzero(c == count), guides.get(int(count))
        if guide is None:
            wide = 12 * math.sqrt(count) + 20
            k = np.arange(max(0, math.floor(count - wide)), math.ceil(count + wide) + 1)
            logs = np.concatenate([[0.0], np.cumsum(math.log(count) - np.log(k[1:]))])
            mass = np.exp(logs - logs.max())
            ends = np.cumsum(mass) / mass.sum()
            guide = k, ends, None
        k, ends, sure = guide
        if sure is None and rows * replicates >= 4 * _CELLS:
            # The weight that all numbers of a cell give; none where an end lies inside the cell.
            cell = np.arange(_CELLS, dtype=np.uint64) << np.uint64(37)
            low, last = (np.searchsorted(ends, (cell + np.uint64(e)).astype(np.float64) / (1 << 53), side="right") for e in (0, (1 << 37) - 1))
            sure = np.where(low == last, k[np.minimum(low, len(k) - 1)], np.nan)
            guide = k, ends, sure
            if len(guides) < _GUIDES:
                guides[int(count)] = guide
        # Blocks stay in a core's cache.
        for start in range(0, len(own), high):
            at = own[start:start + high]
            x = h[at][:, None] + steps[None, :]
            mixed = np.empty_like(x)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                np.right_shift(x, np.uint64(shift), out=mixed)
                np.bitwise_xor(x, mixed, out=x)
                np.multiply(x, np.uint64(factor), out=x)
            np.right_shift(x, np.uint64(31), out=mixed)
            np.bitwise_xor(x, mixed, out=x)
            x, drawn, open_ = x.ravel(), np.empty(x.size), slice(None)
            if sure is not None:
                np.take(sure, np.right_shift(x, np.uint64(48), out=mixed.ravel()).view(np.int64), out=drawn, mode="clip")
                open_ = np.flatnonzero(np.isnan(drawn))
            u = (x[open_] >> np.uint64(11)).astype(np.float64) / (1 << 53)
            drawn[open_] = k[np.minimum(np.searchsorted(ends, u, side="right"), len(k) - 1)]
            out[at] = drawn.reshape(-1, replicates)
    return out


def _bootstrap_means(data: DataFrame, keys: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """(keys, replicate, mean).  Every value gets Poisson weights drawn from a hash of
    its group, value and replicate, so a rerun of a task gives the same weights.  Whole batches are drawn at once."""
    cols = [q(k) for k in keys]
    counted = data.groupBy(*cols, F.col("_y")).agg(F.count(F.lit(1)).alias("_c"))
    counted = counted.withColumn("_h", F.xxhash64(*cols, F.col("_y"), F.lit(seed)))
    schema = T.StructType([
        *data.select(*cols).schema.fields, T.StructField("_r", T.IntegerType()),
        T.StructField("_wy", T.DoubleType()), T.StructField("_w", T.DoubleType()),
    ])
    key_names = list(keys)
    rows_at_once = max(1, _DRAWS // replicates)

    def weigh(batches):
        sums: dict[tuple, np.ndarray] = {}
        guides: dict[int, tuple] = {}

        def rows():
            for label, (wy, w) in sums.items():
                out = {k: [v] * replicates for k, v in zip(key_names, label)}
                yield pd.DataFrame({**out, "_r": np.arange(replicates, dtype=np.int32), "_wy": wy, "_w": w})

        for pdf in batches:
            codes = pdf.groupby(key_names, sort=False).ngroup().to_numpy()
            order = np.argsort(codes, kind="stable")
            pdf = pdf.iloc[order]
            h, c, y, codes = pdf["_h"].to_numpy().view(np.uint64), pdf["_c"].to_numpy(), pdf["_y"].to_numpy(), codes[order]
            for start in range(0, len(pdf), rows_at_once):
                part = slice(start, start + rows_at_once)
                w = poisson_draws(h[part], c[part], replicates, guides)
                first = np.flatnonzero(np.concatenate([[True], np.diff(codes[part]) != 0]))
                parts = np.add.reduceat(w * y[part, None], first), np.add.reduceat(w, first)
                for k, at in enumerate(first):
                    label = tuple(pdf[n].iloc[start + at] for n in key_names)
                    own = sums.setdefault(label, np.zeros((2, replicates)))
                    own[0] += parts[0][k]
                    own[1] += parts[1][k]
            if len(sums) > 1000:  # bounded memory, whatever the number of groups
                yield from rows()
                sums.clear()
        yield from rows()

    drawn = counted.mapInPandas(weigh, schema)
    return drawn.groupBy(*cols, F.col("_r")).agg(
        F.try_divide(F.sum("_wy"), F.sum("_w")).alias("_mean")
    ).filter(F.col("_mean").isNotNull())


def feature_pairs(features: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(features, 2))


def scatter_points(df: DataFrame, x: str, y: str, grouping: str | Sequence[str] = ()) -> DataFrame:
    """The points with both values, and their group."""
    keys = as_list(grouping)
    return drop_missing(df.select(*[q(k) for k in keys], q(x), q(y)), [x, y])


def scatter_bins(
    df: DataFrame, x: str, y: str, grouping: str | Sequence[str] = (), bins: int = 50
) -> DataFrame:
    """Counts on a bins x bins grid: the scatter plot of a large table."""
    keys = as_list(grouping)
    data = scatter_points(df, x, y, keys)
    ends = data.agg(F.struct(
        F.min(q(x)).alias("x0"), F.max(q(x)).alias("x1"), F.min(q(y)).alias("y0"), F.max(q(y)).alias("y1")
    )).scalar()

    def spot(c: str, lo: Column, hi: Column) -> Column:
        share = F.try_divide(q(c).cast("double") - lo, hi - lo)
        return F.coalesce(F.least(F.lit(bins - 1), F.floor(share * bins)), F.lit(0)).cast("int")

    return data.groupBy(
        *[q(k) for k in keys], spot(x, ends["x0"], ends["x1"]).alias("x bin"),
        spot(y, ends["y0"], ends["y1"]).alias("y bin"),
    ).agg(F.count(F.lit(1)).alias("count"))


def pair_matrix(
    df: DataFrame,
    x_vars: Sequence[str],
    y_vars: Sequence[str],
    grouping: str | Sequence[str] = (),
    diagonal: str = "hist",
    corner: bool = False,
    bins: int = 50,
) -> dict[tuple[str, str], DataFrame]:
    """Tables of a grid of plots: distributions on the diagonal, 2-D counts elsewhere."""
    hue = as_list(grouping)[:1]
    out = {}
    for i, y in enumerate(y_vars):
        for j, x in enumerate(x_vars):
            if corner and j > i:
                continue
            if x == y:
                out[x, y] = (
                    histogram_long(df, x, hue, bins=20) if diagonal == "hist" else kde_long(df, x, hue)
                )
            else:
                out[x, y] = scatter_bins(df, x, y, hue, bins)
    return out


# Which columns the ratio panel shows.
PANEL_RULES = {
    "ratio": {"has": ("FLIRR",)},
    "FAD": {"has": ("FAD", "a1", "%"), "lacks": ("/",)},
    "NAD": {"has": ("NAD", "a2", "%"), "lacks": ("/",)},
}


def ratio_panel(
    df: DataFrame, grouping: Sequence[str], rules: Mapping[str, dict] | None = None
) -> dict[str, DataFrame]:
    """The six tables of the ratio overview: scatter, three densities, line, bars."""
    found = pick_features(df, dict(rules or PANEL_RULES))
    missing = [k for k, v in found.items() if v is None]
    if missing:
        raise ValueError(f"no column for {missing}")
    ratio, fad, nad = found["ratio"], found["FAD"], found["NAD"]
    first = list(grouping)[0]
    return {
        "scatter": scatter_bins(df, fad, nad, [first]),
        **{f"density {c}": kde_long(df, c, [first]) for c in (ratio, fad, nad)},
        "line": line_ci(df, first, ratio, list(grouping)[1:2], ci="sd"),
        "bar": mean_error(df, list(grouping), [ratio], "sem"),
    }
