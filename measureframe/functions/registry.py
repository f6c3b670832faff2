"""Functions that job specifications may call by name.

User code registers column functions (``Column -> Column``), grouped-aggregate
functions and table functions (``DataFrame -> DataFrame``) here; a name can be
taken only once.
"""

from __future__ import annotations

from collections.abc import Callable

from measureframe.functions import scalar

KINDS = ("column", "aggregate", "table")

_known: dict[str, dict[str, Callable]] = {kind: {} for kind in KINDS}


def register(kind: str, name: str | None = None) -> Callable[[Callable], Callable]:
    """Decorator: make a function callable by name from a job specification."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")

    def add(fn: Callable) -> Callable:
        key = name or fn.__name__
        if key in _known[kind]:
            raise ValueError(f"{kind} function {key!r} is already registered")
        _known[kind][key] = fn
        return fn

    return add


def lookup(kind: str, name: str) -> Callable:
    try:
        return _known[kind][name]
    except KeyError:
        raise KeyError(f"no {kind} function named {name!r}; known: {names(kind)}") from None


def names(kind: str) -> list[str]:
    return sorted(_known[kind])


for _fn in (
    scalar.tm, scalar.ratio, scalar.nadph_perc, scalar.nadh_perc, scalar.e_perc_single,
    scalar.e_perc_pair, scalar.distance_r, scalar.normalize, scalar.to_db, scalar.from_db,
):
    register("column")(_fn)
