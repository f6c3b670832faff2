"""Derived columns.

``DERIVED`` lists the standard derived columns in the order in which they are
computed; a later one may read an earlier one.  A column is skipped when one of
its inputs is not there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from measureframe.functions import registry
from measureframe.roles import FEATURE, q

# Derived column, function, inputs.
DERIVED: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("NAD(P)H tm", "tm", ("NAD(P)H a1[%]", "NAD(P)H t1", "NAD(P)H a2[%]", "NAD(P)H t2")),
    ("NAD(P)H a2[%]/a1[%]", "ratio", ("NAD(P)H a2[%]", "NAD(P)H a1[%]")),
    ("NADPH %", "nadph_perc", ("NAD(P)H t2",)),
    # Listed before its second input, so it exists only if "NADH %" was in the file.
    ("NADPH/NADH", "ratio", ("NADPH %", "NADH %")),
    ("NADH %", "nadh_perc", ("NADPH %",)),
    ("trp tm", "tm", ("trp a1[%]", "trp t1", "trp a2[%]", "trp t2")),
    ("trp E%1", "e_perc_single", ("trp tm",)),
    ("trp E%2", "e_perc_pair", ("trp t1", "trp t2")),
    ("trp E%3", "e_perc_single", ("trp t1",)),
    ("trp r1", "distance_r", ("trp E%1",)),
    ("trp r2", "distance_r", ("trp E%2",)),
    ("trp r3", "distance_r", ("trp E%3",)),
    ("trp a1[%]/a2[%]", "ratio", ("trp a1[%]", "trp a2[%]")),
    ("FAD tm", "tm", ("FAD a1[%]", "FAD t1", "FAD a2[%]", "FAD t2")),
    ("FAD a1[%]/a2[%]", "ratio", ("FAD a1[%]", "FAD a2[%]")),
    ("FAD photons/NAD(P)H photons", "ratio", ("FAD photons", "NAD(P)H photons")),
    ("NAD(P)H tm/FAD tm", "ratio", ("NAD(P)H tm", "FAD tm")),
    ("FLIRR", "ratio", ("NAD(P)H a2[%]", "FAD a1[%]")),
    ("NADPH a2/FAD a1", "ratio", ("NAD(P)H a2", "FAD a1")),
)


def derivable(
    columns: Sequence[str],
    derived: Sequence[tuple[str, str, Sequence[str]]] = DERIVED,
    names: Mapping[str, str] | None = None,
) -> tuple[list[str], list[str]]:
    """Names that can and cannot be derived from ``columns``."""
    names = names or {}
    have, done, skipped = set(columns), [], []
    for out, _, inputs in derived:
        target = names.get(out, out)
        if all(names.get(i, i) in have for i in inputs):
            have.add(target)
            done.append(target)
        else:
            skipped.append(target)
    return done, skipped


def derive(
    df: DataFrame,
    derived: Sequence[tuple[str, str, Sequence[str]]] = DERIVED,
    names: Mapping[str, str] | None = None,
) -> DataFrame:
    """Append every derivable column; ``names`` maps standard names to those of ``df``."""
    names = names or {}
    done = set(derivable(df.columns, derived, names)[0])
    pending = [
        (names.get(out, out), fn, [names.get(i, i) for i in inputs])
        for out, fn, inputs in derived
        if names.get(out, out) in done
    ]
    # One projection per run of columns that do not read each other.
    while pending:
        level, fresh = [], set()
        for entry in pending:
            if fresh.intersection(entry[2]) or entry[0] in fresh:
                break
            level.append(entry)
            fresh.add(entry[0])
        pending = pending[len(level):]
        cols = {
            out: registry.lookup("column", fn)(*[q(i) for i in inputs]).alias(
                out, metadata={"role": FEATURE}
            )
            for out, fn, inputs in level
        }
        df = df.select(
            *[cols.get(c, q(c)) for c in df.columns],
            *[c for n, c in cols.items() if n not in df.columns],
        )
    return df


def add_constant(df: DataFrame, source: str, target: str, value: float) -> DataFrame:
    return df.select(
        *[q(c) for c in df.columns if c != target], (q(source) + F.lit(value)).alias(target)
    )
