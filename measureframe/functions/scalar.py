"""Column functions: lifetimes, ratios, efficiencies, decibels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
FULL_QUENCH_LIFETIME = 3100
NADPH_LOW, NADPH_HIGH = 1500, 4400
FORSTER_RADIUS = 2.1


def tm(a1p: Column, t1: Column, a2p: Column, t2: Column) -> Column:
    """Mean lifetime weighted by the two amplitude percentages."""
    return (a1p * t1 + a2p * t2) / F.lit(100.0)


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den)


def nadph_perc(t2: Column) -> Column:
    return (t2 - F.lit(NADPH_LOW)) / F.lit(float(NADPH_HIGH - NADPH_LOW)) * F.lit(100.0)


def nadh_perc(percent: Column) -> Column:
    return F.lit(100.0) - percent


def e_perc_single(lifetime: Column, const: float = FULL_QUENCH_LIFETIME) -> Column:
    """Transfer efficiency against a constant donor lifetime."""
    return (F.lit(1.0) - F.try_divide(lifetime, F.lit(float(const)))) * F.lit(100.0)


def e_perc_pair(t1: Column, t2: Column) -> Column:
    return (F.lit(1.0) - F.try_divide(t1, t2)) * F.lit(100.0)


def distance_r(e_perc: Column) -> Column:
    """Donor-acceptor distance from the efficiency in percent."""
    base = F.try_divide(F.lit(100.0), e_perc) - F.lit(1.0)
    return F.when(base >= 0, F.lit(FORSTER_RADIUS) * F.pow(base, F.lit(1.0 / 6)))


def normalize(value: Column, total: Column) -> Column:
    return F.try_divide(value, total)


def to_db(value: Column) -> Column:
    return F.lit(10.0) * F.log10(value)


def from_db(value: Column) -> Column:
    return F.pow(F.lit(10.0), value / F.lit(10.0))
