"""Range, category and complete-series filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from measureframe.roles import categories, features, q


@dataclass(frozen=True)
class RangeFilter:
    """Keep ``low <= x <= high``; ``dropna`` decides about missing values.

    A range whose low end lies above its high end holds no value.  Of the allowed limits,
    which may be given in either order, the lower one raises ``low``; the upper one is only carried along.
    """

    name: str
    low: float = 0.0
    high: float = 100.0
    selected: bool = False
    dropna: bool = True
    lowest: float | None = None
    highest: float | None = None

    def bounds(self) -> tuple[float, float]:
        """The range that holds, inside the allowed limits."""
        both = self.lowest is not None and self.highest is not None
        lowest = min(self.lowest, self.highest) if both else self.lowest
        return (self.low if lowest is None else max(self.low, lowest)), self.high

    def keeps(self) -> Column:
        """Never-null condition, so that its negation is the complement."""
        low, high = self.bounds()
        inside = F.coalesce(q(self.name).between(low, high), F.lit(False))
        return inside if self.dropna else inside | q(self.name).isNull()

    def condition(self) -> Column:
        """Plain comparison of the column, which the scan can use."""
        low, high = self.bounds()
        inside = q(self.name).between(low, high)
        return inside if self.dropna else inside | q(self.name).isNull()


# Feature, low, high, selected by the filter operator.
_DEFAULTS: tuple[tuple[str, float, float, bool], ...] = (
    ("trp t1", 0, 2500, False), ("trp t2", 0, 8000, False), ("trp tm", 0, 4000, False),
    ("trp a1[%]", 0, 100, False), ("trp a2[%]", 0, 100, False),
    ("trp a1[%]/a2[%]", 0, 2, False), ("trp E%1", 0, 100, False),
    ("trp E%2", 0, 100, False), ("trp E%3", 0, 100, False), ("trp r1", 0, 15, False),
    ("trp r2", 0, 3, False), ("trp r3", 0, 3, False), ("trp chi", 0, 4.7, False),
    ("trp photons", 0, 160, False), ("NAD(P)H a1", 10, 800, True),
    ("NAD(P)H a1[%]", 0, 100, False), ("NAD(P)H a2", 5, 300, True),
    ("NAD(P)H a2[%]", 0, 100, False), ("NAD(P)H t1", 10, 1000, True),
    ("NAD(P)H t2", 2000, 7000, True), ("NAD(P)H tm", 0, 2000, False),
    ("NAD(P)H photons", 10, 2000, True), ("NADPH %", 0, 99, False),
    ("NADH %", 0, 100, False), ("NADPH/NADH", 0, 3, False), ("NAD(P)H chi", 0.7, 2.0, False),
    ("FAD t1", 10, 1500, True), ("FAD t2", 1000, 6000, True), ("FAD tm", 0, 2500, False),
    ("FAD a1", 10, 800, True), ("FAD a1[%]", 0, 100, False), ("FAD a2", 5, 300, True),
    ("FAD a2[%]", 0, 100, False), ("FAD a1[%]/a2[%]", 0, 16, False), ("FLIRR", 0, 2.4, False),
    ("FAD chi", 0.7, 2.0, False), ("FAD photons", 10, 2000, True),
    ("FAD photons/NAD(P)H photons", 0, 2, False),
)
DEFAULT_RANGES: dict[str, RangeFilter] = {
    name: RangeFilter(name, low, high, selected) for name, low, high, selected in _DEFAULTS
}

# Ranges and selections of the default configuration where they differ.
CONFIGURED_RANGES: dict[str, RangeFilter] = {
    **{name: replace(f, selected=False) for name, f in DEFAULT_RANGES.items()},
    "trp chi": RangeFilter("trp chi", 0, 4.7, True),
    "NAD(P)H chi": RangeFilter("NAD(P)H chi", 0.7, 4.7, True),
    "FAD chi": RangeFilter("FAD chi", 0.7, 4.7, True),
    "NAD(P)H a1": RangeFilter("NAD(P)H a1", 0, 1000),
    "FAD a1": RangeFilter("FAD a1", 10, 500),
    "FAD a2": RangeFilter("FAD a2", 10, 300),
    "FAD photons": RangeFilter("FAD photons", 10, 1000),
}


def default_ranges(df: DataFrame, configured: bool = False) -> list[RangeFilter]:
    """The default range of every feature; 0..100, unselected, for unlisted ones.

    ``configured`` takes the ranges of the default configuration.
    """
    known = CONFIGURED_RANGES if configured else DEFAULT_RANGES
    return [known.get(f, RangeFilter(f)) for f in features(df)]


def active_filters(
    df: DataFrame, filters: Sequence[RangeFilter], only_selected: bool = True
) -> tuple[list[RangeFilter], list[RangeFilter]]:
    """Filters that apply to ``df`` (sorted by name), and those that do not."""
    used, skipped = [], []
    for f in sorted(filters, key=lambda f: f.name):
        ok = f.name in df.columns and (f.selected or not only_selected)
        (used if ok else skipped).append(f)
    return used, skipped


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def range_filter(
    df: DataFrame, name: str, low: float = 0.0, high: float = 100.0, dropna: bool = True
) -> DataFrame:
    """Rows inside a range; an unknown column filters nothing."""
    if name not in df.columns:
        return df
    return df.filter(RangeFilter(name, low, high, True, dropna).condition())


def category_filter(df: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows whose labels are among the listed ones."""
    for name, values in wanted.items():
        df = df.filter(q(name).isin(list(values)))
    return df


def filter_table(
    df: DataFrame,
    ranges: Sequence[RangeFilter] = (),
    wanted: Mapping[str, Sequence[str]] | None = None,
    use_defaults: bool = False,
    use: bool = True,
) -> DataFrame:
    """Category and range filters in one conjunction."""
    if not use:
        return df
    ranges = list(ranges)
    if use_defaults:
        given = {f.name for f in ranges}
        ranges += [f for f in default_ranges(df) if f.name not in given]
    df = category_filter(df, wanted or {})
    for f in active_filters(df, ranges)[0]:
        df = df.filter(f.condition())
    return df


def discarded(
    df: DataFrame,
    ranges: Sequence[RangeFilter],
    wanted: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Rows that pass the category filters and fail a range filter."""
    kept = _all([f.keeps() for f in active_filters(df, ranges)[0]])
    return category_filter(df, wanted or {}).filter(~kept)


def filter_report(df: DataFrame, ranges: Sequence[RangeFilter]) -> DataFrame:
    """Rows dropped by each filter, by all together, and rows left: one pass."""
    used, _ = active_filters(df, ranges)
    kept = _all([f.keeps() for f in used])
    counts = df.agg(
        *[F.count_if(~f.keeps()).alias(f"_{i}") for i, f in enumerate(used)],
        F.count_if(~kept).alias("_dropped"), F.count_if(kept).alias("_left"),
    )
    rows = [F.struct(F.lit(f.name).alias("filter"), F.col(f"_{i}").alias("rows")) for i, f in enumerate(used)]
    rows += [
        F.struct(F.lit("all dropped").alias("filter"), F.col("_dropped").alias("rows")),
        F.struct(F.lit("remaining").alias("filter"), F.col("_left").alias("rows")),
    ]
    return counts.select(F.inline(F.array(*rows)))


def series_filter(
    df: DataFrame,
    required: Mapping[str, Sequence[str]],
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Drop groups with an incomplete series.

    For series column S and required labels V, the group is every other category
    (or ``keys``); a group is dropped when a label of V that occurs anywhere is
    absent from it.  Rows with a missing group label are in no group and stay.
    """
    for series, labels in required.items():
        group = list(keys) if keys is not None else [c for c in categories(df) if c != series]
        has = [F.max(F.when(q(series) == v, 1).otherwise(0)) for v in labels]
        seen = df.filter(q(series).isin(list(labels)))
        need = seen.agg(F.count_distinct(q(series)).alias("n")).scalar()
        flags = df.groupBy(*[q(k) for k in group]).agg(
            reduce(lambda a, b: a + b, has).alias("_has")
        )
        # Only incomplete groups travel to the join.
        names = [f"_g{i}" for i in range(len(group))]
        broken = flags.filter(F.col("_has") < need).select(
            *[q(k).alias(n) for k, n in zip(group, names)]
        )
        match = reduce(lambda a, b: a & b, [q(k) == q(n) for k, n in zip(group, names)])
        df = df.join(broken, match, "left_anti")
    return df


def apply_filters(
    df: DataFrame,
    ranges: Sequence[RangeFilter],
    series: Mapping[str, Sequence[str]] | None = None,
    only_selected: bool = True,
) -> tuple[DataFrame, list[RangeFilter], list[RangeFilter], DataFrame]:
    """Filtered table, used filters, skipped filters, report of dropped rows."""
    used, skipped = active_filters(df, ranges, only_selected)
    out = df
    for f in used:
        out = out.filter(f.condition())
    chosen = [replace(f, selected=True) for f in used]
    return series_filter(out, series or {}), used, skipped, filter_report(df, chosen)
