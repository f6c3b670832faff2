"""Column roles, column names and missing values.

Roles live in the schema metadata (``{"role": "category"}``); without metadata a
string, boolean, date or timestamp column is a category and a number a feature.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

CATEGORY = "category"
FEATURE = "feature"

#: Default separator between the parts of a composed column name.
SEP = "__"

# Category names recognised in file headers.
RESERVED_CATEGORIES = (
    "Cell line", "Category", "Cat", "Cluster", "FOV", "Well", "Cell", "Treatment",
    "Treatment 1", "Treatment 2", "Treatment 1 & 2", "Time", "Compartment", "New Cat",
    "Origin", "AE Label", "Source", "Combined", "Cell line-Compartment",
    "Cell line-FOV", "Cell line-Treatment", "Cell line-Cell", "Compartment-Cell",
    "Compartment-FOV", "Compartment-Treatment", "FOV-Time", "FOV-Well", "Time-Well",
    "Treatment-Time", "Treatment-FOV", "FOV-Cell", "FOV-Treatment", "Treatment-Cell",
)

_LABEL_TYPES = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def q(name: str, frame: str | None = None) -> Column:
    """Column by its literal name, whatever characters it holds."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{frame}.{quoted}" if frame else quoted)


def as_list(value: str | Iterable[str] | None) -> list[str]:
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def join_name(*parts: str, sep: str = SEP) -> str:
    return sep.join(p for p in parts if p != "")


def unique_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, or ``wanted_1``, ``wanted_2``... when it is taken."""
    used = set(taken)
    name, i = wanted, 0
    while name in used:
        i += 1
        name = f"{wanted}_{i}"
    return name


def role_of(field: T.StructField) -> str | None:
    role = (field.metadata or {}).get("role")
    if role in (CATEGORY, FEATURE):
        return role
    if isinstance(field.dataType, _LABEL_TYPES):
        return CATEGORY
    if isinstance(field.dataType, T.NumericType):
        return FEATURE
    return None


def categories(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if role_of(f) == CATEGORY]


def features(df: DataFrame) -> list[str]:
    return [
        f.name for f in df.schema.fields
        if role_of(f) == FEATURE and isinstance(f.dataType, T.NumericType)
    ]


def as_category(col: Column, name: str, order: Sequence[str] | None = None) -> Column:
    """``col`` under ``name`` with the category role (and a value order)."""
    meta: dict = {"role": CATEGORY}
    if order is not None:
        meta["order"] = list(order)
    return col.alias(name, metadata=meta)


def mark_categories(df: DataFrame, names: Iterable[str]) -> DataFrame:
    chosen = set(names)
    return df.select(
        *[as_category(q(c), c) if c in chosen else q(c) for c in df.columns]
    )


def value_order(df: DataFrame, name: str) -> list[str] | None:
    return (df.schema[name].metadata or {}).get("order")


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Replace or append columns by literal name (``withColumns`` reads dots as fields)."""
    keep = [new[c].alias(c) if c in new else q(c) for c in df.columns]
    return df.select(*keep, *[c.alias(n) for n, c in new.items() if n not in df.columns])


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def nan_to_null(df: DataFrame) -> DataFrame:
    """One missing value: NaN becomes null in every floating column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    chosen = set(floats)
    return df.select(*[
        F.when(~F.isnan(q(c)), q(c)).alias(c, metadata=df.schema[c].metadata or {})
        if c in chosen else q(c)
        for c in df.columns
    ])


def inf_to_null(df: DataFrame, names: Iterable[str]) -> DataFrame:
    inf = float("inf")
    return with_columns(df, {
        c: F.when((q(c) != F.lit(inf)) & (q(c) != F.lit(-inf)), q(c)) for c in names
    })


def drop_missing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Rows in which all of ``names`` are present."""
    for name in names:
        df = df.filter(q(name).isNotNull())
    return df


def require(df: DataFrame, cats: Iterable[str] = (), feats: Iterable[str] = ()) -> None:
    """Check that an operator finds its input columns."""
    missing = [c for c in [*cats, *feats] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in table: {missing}")
    text = [c for c in feats if not isinstance(df.schema[c].dataType, T.NumericType)]
    if text:
        raise ValueError(f"features must be numeric: {text}")


def pick_features(df: DataFrame, rules: dict[str, dict]) -> dict[str, str | None]:
    """First feature per rule: name parts it must (``has``) and must not (``lacks``) hold."""
    picked: dict[str, str | None] = {}
    for key, rule in rules.items():
        picked[key] = next(
            (
                c for c in features(df)
                if all(p in c for p in rule.get("has", ()))
                and not any(p in c for p in rule.get("lacks", ()))
            ),
            None,
        )
    return picked
