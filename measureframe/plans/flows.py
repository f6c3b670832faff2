"""Ready-made flows: compositions of the operators on one or two input tables.

A flow returns its result tables by name.  Nothing is computed before a table is
used, except where a model must be fitted.  The filtered input, which every branch
reads, is persisted by the caller's choice of ``persist``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from measureframe.operators.distributions import (
    feature_pairs, kde_long, line_ci, pair_matrix, scatter_bins,
)
from measureframe.operators.filters import RangeFilter, filter_table
from measureframe.operators.joins import concat_rows
from measureframe.operators.learning import pca
from measureframe.operators.networks import ae_apply, ae_augment, ae_fit
from measureframe.operators.reshape import label_values, pivot_table, sort_rows, unpivot_table
from measureframe.operators.series import series_analysis
from measureframe.operators.statistics import correlation_matrix, ks_test
from measureframe.operators.summary import mean_error, relative_change, summarize
from measureframe.roles import SEP, features as feature_columns, join_name

Tables = dict[str, DataFrame]


def shared(df: DataFrame, persist: bool) -> DataFrame:
    """An input that several branches read."""
    return df.persist(StorageLevel.MEMORY_AND_DISK) if persist else df


def select_outputs(
    results: Mapping[str, object], key: str = "(.*?)", value: str | None = None
) -> list:
    """Entries whose name (and text value) match the patterns."""
    found = [v for k, v in results.items() if re.search(key, k)]
    if value is None:
        return found
    return [v for v in found if not isinstance(v, str) or re.search(value, v)]


def flow_basic(
    df: DataFrame,
    grouping: Sequence[str],
    features: Sequence[str],
    reference_value: str | None = None,
    ci: float | str = 95,
    scatter: Sequence[str] | None = None,
    channels: Mapping[str, str] | None = None,
    persist: bool = False,
    sep: str = SEP,
) -> Tables:
    """Summary, counts, pair tables per channel, relative change, line and density tables."""
    data = shared(df, persist)
    first, rest = grouping[0], list(grouping[1:])
    if reference_value is None:
        reference_value = label_values(data, [first])[0][0]
    out: Tables = {
        "Stats": summarize(data, first, features, ["count", "median", "mean", "std", "sem"], sep),
        "Counts": summarize(data, grouping, features[:1], ["count"], sep),
    }
    for prefix, part in (channels or {"FAD": "FAD", "NADPH": "NAD"}).items():
        members = [f for f in features if part in f]
        for (x, y), table in pair_matrix(data, members, members, first, "kde").items():
            out[f"{prefix}-Pair {x} | {y}"] = table
    relative = relative_change(data, rest, features, first, reference_value)
    out["Relative Change"] = relative
    out["Relative Stats"] = summarize(
        relative, list(reversed(grouping)), [f"rel {f}" for f in features], ["mean"], sep
    )
    points = list(scatter) if scatter is not None else _ratio_inputs(data)
    for x, y in feature_pairs(points):
        out[f"Scatter {x} | {y}"] = scatter_bins(data, x, y, first)
    for f in features:
        out[f"Line rel {f}"] = line_ci(relative, first, f"rel {f}", rest[:1], ci)
        out[f"KDE {f}"] = kde_long(data, f, first)
    return out


def _ratio_inputs(df: DataFrame) -> list[str]:
    return [
        c for c in feature_columns(df)
        if "FLIRR" not in c.upper() and "/" not in c and "%" in c
        and (("FAD" in c and "a1" in c) or ("NAD" in c and "a2" in c))
    ]


def flow_augment(
    df: DataFrame,
    grouping: Sequence[str],
    features: Sequence[str],
    series: str,
    ranges: Sequence[RangeFilter] = (),
    sets: int = 4,
    epochs: int = 6,
    batch_sizes: Sequence[int] = (128, 64),
    learning_rates: Sequence[float] = (1e-5, 2e-5),
    weight_decays: Sequence[float] = (1e-7, 1e-8),
    network: str = "AE Simulator 1-6",
    checkpoint_interval: int = 2,
    persist: bool = True,
    seed: int = 0,
) -> Tables:
    """Filter, train a grid of simulators, compare losses, simulate and describe new rows."""
    data = shared(filter_table(df, ranges, use_defaults=not ranges), persist)
    out: Tables = {"Correlation": correlation_matrix(data, features, "spearman")}
    for f in features:
        out[f"KDE {f}"] = kde_long(data, f, series)
    fitted = ae_fit(
        data, features, grouping, series, network, epochs, batch_sizes, learning_rates, weight_decays,
        checkpoint_interval=checkpoint_interval, rescale=True, model_name=f"AEAugment-{len(features)}", seed=seed,
    )
    config = ["Batch Size", "Learning Rate", "Weight Decay"]
    loss = concat_rows({"AE Loss": fitted["loss"]})
    out["Loss"] = loss
    out["Best Loss"] = summarize(
        loss, ["Source", *config], ["Training Loss", "Validation Loss", "Model File"], ["min"]
    )
    long = unpivot_table(loss, ["Training Loss", "Validation Loss"], "Loss Type", "Loss Value")
    out["Loss Curves"] = line_ci(long, "Epoch", "Loss Value", ["Loss Type", *config], ci="sd")
    for f in ("Training Loss", "Validation Loss"):
        out[f"Bar {f}"] = mean_error(loss, ["Epoch", *config], f)
    models = fitted["models"].filter(F.col("epoch") == epochs)
    out["Models"] = fitted["models"]
    simulated = shared(ae_augment(data, features, grouping, sets, models, seed=seed), persist)
    kept = filter_table(simulated, ranges, use_defaults=not ranges)
    out["Simulated"] = kept
    for name in [r["model_file"] for r in models.select("model_file").collect()]:
        part = kept.filter(F.col("model_file") == name)
        out[f"{name}: Correlation"] = correlation_matrix(part, features, "spearman")
        out[f"{name}: Summary"] = summarize(part, series, features, ["min", "max", "median", "count"])
    # The density of all models in one job: the model is one more category.
    for f in features:
        out[f"Simulated KDE {f}"] = kde_long(kept, f, ["model_file", series])
    return out


def flow_features(
    train: DataFrame,
    run: DataFrame,
    grouping: Sequence[str],
    features: Sequence[str],
    series: str,
    ratio: str,
    ranges: Sequence[RangeFilter] = (),
    control: str = "Ctrl",
    skip: str | None = "15",
    epochs: int = 6,
    batch_sizes: Sequence[int] = (128, 64),
    learning_rates: Sequence[float] = (1e-5, 2e-5),
    weight_decays: Sequence[float] = (1e-7, 1e-8),
    network: str = "AE Dimensionality Reduction 2-10",
    checkpoint_interval: int = 2,
    alpha: float = 0.05,
    persist: bool = True,
    seed: int = 0,
    sep: str = SEP,
) -> Tables:
    """Compare the ratio, the first component and the learned feature along a series."""
    fit_on = shared(filter_table(train, ranges, use_defaults=not ranges), persist)
    data = shared(filter_table(run, ranges, use_defaults=not ranges), persist)
    components, explained = pca(data, features)
    fitted = ae_fit(
        fit_on, features, grouping, series, network, epochs, batch_sizes, learning_rates, weight_decays,
        checkpoint_interval=checkpoint_interval, rescale=True, model_name=f"AEFeature-{len(features)}", seed=seed,
    )
    _, coded = ae_apply(data, fitted["models"].filter(F.col("epoch") == epochs), features)
    out: Tables = {
        "PCA Components": components, "PCA Explained": explained,
        "Loss": fitted["loss"], "Models": fitted["models"], "Features": coded,
    }
    names = [r["model_file"] for r in fitted["loss"].filter(F.col("Epoch") == str(epochs)).select(
        F.col("`Model File`").alias("model_file")).collect()]
    sources: list[tuple[str, DataFrame, str]] = [("FLIRR", data, ratio), ("PCA", components, "PC 1")]
    sources += [
        (f"AERun {n}", coded.filter(F.col("model_file") == n).drop("model_file"), "Feature 1") for n in names
    ]
    steps = [v for (v,) in label_values(data, [series]) if skip is None or skip not in str(v)]
    tests: Tables = {}
    for tag, table, feature in sources:
        out[f"{tag}: KDE"] = kde_long(table, feature, series)
        keys = [*[g for g in reversed(grouping) if g != series], series]
        means = summarize(table, keys, feature, ["mean"], sep)
        mean = join_name(feature, "mean", sep=sep)
        wide = pivot_table(means, series, mean, steps, index=keys[:-1], sep=sep)
        changes = series_analysis(
            wide, [join_name(mean, str(s), sep=sep) for s in steps],
            ("delta", "delta_cum", "delta_norm"), sep=sep,
        )
        out[f"{tag}: Series"] = changes
        normal = [
            join_name(mean, f"normalized delta {a}:{b}", sep=sep) for a, b in zip(steps, steps[1:])
        ]
        first = [n for n, a in zip(normal, steps) if control.lower() in str(a).lower()]
        out[f"{tag}: Sorted"] = sort_rows(changes, first) if first else changes
        out[f"{tag}: Bars"] = mean_error(changes, keys[:-1], normal, "sem", "stacked")
        tests[tag] = ks_test(table, feature, series, grouping, alpha)
    out["KS"] = concat_rows(tests)
    return out


FLOWS: dict[str, Callable[..., Tables]] = {
    "basic": flow_basic, "augment": flow_augment, "features": flow_features,
}
