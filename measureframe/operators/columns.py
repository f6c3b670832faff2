"""Headers and category labels: rename, drop, reorder, combine, relabel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain, combinations

from pyspark.sql import DataFrame, functions as F

from measureframe.roles import as_category, as_list, categories, q, value_order

# Header parts replaced on import, and header parts dropped after that.
HEADER_PARTS = {"Exc1_-Ch1-_": "trp ", "Exc1_-Ch2-_": "NAD(P)H ", "Exc2_-Ch3-_": "FAD "}
DROPPED_PARTS = ("Exc1_", "Exc2_", "Exc3_")


def renamed_headers(columns: Sequence[str], parts: Mapping[str, str] = HEADER_PARTS) -> dict[str, str]:
    """Old to new name for every header the literal replacements change."""
    changed = {}
    for old in columns:
        new = old
        for part, by in parts.items():
            new = new.replace(part, by)
        if new != old:
            changed[old] = new
    return changed


def rename_columns(df: DataFrame, parts: Mapping[str, str] = HEADER_PARTS) -> DataFrame:
    changed = renamed_headers(df.columns, parts)
    return df.select(*[q(c).alias(changed[c]) if c in changed else q(c) for c in df.columns])


def dropped_headers(
    columns: Sequence[str],
    patterns: Sequence[str] = DROPPED_PARTS,
    how: str = "contains",
    blank_header: bool = True,
) -> list[str]:
    """Headers matched by any pattern (``contains``, ``startswith``, ``endswith``, ``is``)."""
    tests = {
        "contains": lambda c, p: p in c,
        "startswith": str.startswith,
        "endswith": str.endswith,
        "is": str.__eq__,
    }
    test = tests[how]
    return [
        c for c in columns
        if any(test(c, p) for p in patterns) or (blank_header and c == " ")
    ]


def drop_columns(
    df: DataFrame,
    patterns: Sequence[str] = DROPPED_PARTS,
    how: str = "contains",
    blank_header: bool = True,
) -> DataFrame:
    gone = set(dropped_headers(df.columns, patterns, how, blank_header))
    return df.select(*[q(c) for c in df.columns if c not in gone])


def reorder_columns(df: DataFrame, first: Sequence[str] = ()) -> DataFrame:
    """``first`` (or the sorted categories), then every other column sorted."""
    head = list(first) or sorted(categories(df))
    return df.select(*[q(c) for c in [*head, *sorted(set(df.columns) - set(head))]])


def combine_categories(
    df: DataFrame, combos: Sequence[Sequence[str]] | None = None, sep: str = "-"
) -> DataFrame:
    """Append ``A-B`` columns; all pairs of categories when no combination is given.

    A missing part makes the combined label missing.
    """
    if combos is None:
        combos = list(combinations(sorted(categories(df)), 2))
    made = []
    for combo in combos:
        parts = list(chain.from_iterable((F.lit(sep), q(c)) for c in combo))[1:]
        made.append(as_category(F.concat(*parts), "-".join(combo)))
    return df.select(*[q(c) for c in df.columns], *made)


def rename_values(
    df: DataFrame, columns: str | Sequence[str], pattern: str = "^0+", replacement: str = ""
) -> DataFrame:
    """Regular-expression replacement inside category labels."""
    chosen = set(as_list(columns))
    return df.select(*[
        as_category(F.regexp_replace(q(c).cast("string"), pattern, replacement), c)
        if c in chosen else q(c)
        for c in df.columns
    ])


def map_values(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replace single labels, keeping the others."""
    if not mapping:
        return df
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    order = value_order(df, column)
    if order is not None:
        order = list(dict.fromkeys(mapping.get(v, v) for v in order))
    # try_element_at: a label without an entry stays as it is.
    new = as_category(F.coalesce(F.try_element_at(table, q(column)), q(column)), column, order)
    return df.select(*[new if c == column else q(c) for c in df.columns])


def round_view(df: DataFrame, decimals: int = 3, columns: Sequence[str] | None = None) -> DataFrame:
    """Rounded copy for output; the input table keeps full precision."""
    chosen = {
        f.name for f in df.schema.fields
        if f.dataType.typeName() in ("double", "float") and (columns is None or f.name in columns)
    }
    return df.select(*[F.round(q(c), decimals).alias(c) if c in chosen else q(c) for c in df.columns])
