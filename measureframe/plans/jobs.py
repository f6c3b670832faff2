"""Batch jobs from a JSON specification, for ``spark-submit``.

The specification is a nested dictionary::

    {"import": {...}, "preprocess": {...}, "filters": {...},
     "steps": [{"op": "summarize", "args": {...}, "as": "stats"}, ...],
     "output": {"path": ..., "format": "parquet"}}

``imports`` names further tables: ``{"controls": {"paths": [...], "parser": ...}}``, read like the main one, which is ``data``.
``steps`` name operators of ``OPERATORS`` or registered table functions.  A step reads the result named by ``input``
(default: the step before in the list), or several: ``inputs`` is a list of results for the operator's first parameters, or
``{"left": "data", "right": "controls"}`` by their names.  ``concat_rows`` takes the mapping itself as its tables.
Steps run in the order that their inputs ask for, whatever their place in the list; a result that several
steps read is computed once, and released with the job.
"""

from __future__ import annotations

import argparse
import copy
import json
from collections import Counter
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from measureframe.functions import registry
from measureframe.functions.derive import DERIVED, derive
from measureframe.operators import columns, distributions, filters, joins, learning, networks, reshape, series, statistics, summary
from measureframe.operators.filters import RangeFilter, filter_table, series_filter
from measureframe.plans import flows
from measureframe.roles import require
from measureframe.sources.sink import write_results, write_table
from measureframe.sources.text import ImportSpec, read_measurements

DEFAULTS: dict[str, Any] = {
    "imports": {},
    "import": {
        "delimiter": "\t", "parser": "none", "exclude": [], "extensions": [".txt", ".csv"],
        "combos": [], "types": None, "shared_header": False,
    },
    "preprocess": {
        "headers": dict(columns.HEADER_PARTS), "drop": list(columns.DROPPED_PARTS),
        "derive": [[n, f, list(a)] for n, f, a in DERIVED],
    },
    "filters": {"use": False, "ranges": [], "series": {}, "categories": {}},
    "steps": [],
    "output": {"path": None, "format": "parquet"},
}
REQUIRED = (
    ("import", "exclude"), ("import", "delimiter"), ("import", "parser"),
    ("preprocess", "headers"), ("preprocess", "drop"), ("preprocess", "derive"),
    ("filters", "ranges"), ("filters", "series"), ("steps",),
)

#: Operators that a step can name: table in, table (or named tables) out.
OPERATORS = {
    fn.__name__: fn
    for fn in (
        columns.rename_columns, columns.drop_columns, columns.reorder_columns, columns.combine_categories,
        columns.rename_values, columns.map_values, columns.round_view, derive,
        filters.range_filter, filters.category_filter, filters.series_filter,
        joins.distinct_rows, reshape.pivot_table, reshape.unpivot_table, reshape.sort_rows,
        reshape.top_rows, reshape.order_categories, summary.summarize, summary.group_counts,
        summary.mean_error, summary.bar_table, summary.relative_change, summary.categorize,
        summary.group_transform, summary.change_table, series.series_analysis, series.series_analysis_long,
        distributions.histogram, distributions.histogram_long, distributions.kde, distributions.kde_long,
        distributions.box_stats, distributions.box_outliers, distributions.line_ci,
        distributions.scatter_points, distributions.scatter_bins, distributions.swarm_points,
        statistics.correlation_matrix, statistics.ks_test, learning.standardize, learning.kmeans,
        learning.minmax_impute, learning.pca, learning.random_forest, learning.group_split, learning.label_encode,
        joins.merge_tables, joins.concat_rows, joins.zip_columns, joins.join_labels, joins.except_rows,
        filters.filter_report, filters.discarded, networks.ae_fit, networks.ae_apply, networks.ae_augment,
        flows.flow_basic, flows.flow_augment, flows.flow_features,
    )
}
#: Names of the tables of operators that return several in a row; others are numbered.
RESULTS = {"pca": ("components", "explained"), "random_forest": ("importances", "accuracy"), "ae_apply": ("decoded", "encoded")}


def get(spec: Mapping, path: str | Sequence[str], default: Any = None) -> Any:
    """Value at a path, or the first value (depth first) under a single key."""
    if not isinstance(path, str):
        node: Any = spec
        for key in path:
            if not isinstance(node, Mapping) or key not in node:
                return default
            node = node[key]
        return node
    if path in spec:
        return spec[path]
    for child in spec.values():
        if isinstance(child, Mapping):
            found = get(child, path, _ABSENT)
            if found is not _ABSENT:
                return found
    return default


_ABSENT = object()


def update(spec: dict, path: Sequence[str], value: Any) -> dict:
    out = copy.deepcopy(spec)
    node = out
    for key in path[:-1]:
        node = node.setdefault(key, {})
    node[path[-1]] = value
    return out


def remove(spec: dict, path: Sequence[str]) -> dict:
    out = copy.deepcopy(spec)
    node = out
    for key in path[:-1]:
        node = node.get(key, {})
    node.pop(path[-1], None)
    return out


def missing_keys(spec: Mapping) -> list[tuple[str, ...]]:
    """Required keys that are not there, or null."""
    return [path for path in REQUIRED if get(spec, path, None) is None]


def _moved(spec: Mapping) -> dict:
    """Keys of the sections that stand at the top, or in another section, are moved to their own; what is there already stays."""
    home = {k: section for section, part in DEFAULTS.items() if section != "imports" and isinstance(part, Mapping) for k in part}
    out = copy.deepcopy(dict(spec))
    for where in [out, *[out[s] for s in DEFAULTS if s in home.values() and isinstance(out.get(s), dict)]]:
        for key in [k for k in where if k in home and k not in DEFAULTS]:
            section = out.setdefault(home[key], {})
            if section is not where and isinstance(section, dict):
                section.setdefault(key, where.pop(key))
                where.pop(key, None)
    return out


def repaired(spec: Mapping) -> dict:
    """The specification with its keys in place, and defaults wherever it says nothing or has a required key null."""
    spec = _moved(spec)
    for path in REQUIRED:
        if get(spec, path, _ABSENT) is None:
            spec = remove(spec, path)

    def fill(given: Any, default: Any) -> Any:
        if not isinstance(default, Mapping) or not isinstance(given, Mapping):
            return copy.deepcopy(given)
        out = {k: fill(given[k], v) if k in given else copy.deepcopy(v) for k, v in default.items()}
        out.update({k: copy.deepcopy(v) for k, v in given.items() if k not in out})
        return out

    return fill(spec, DEFAULTS)


def load_spec(text: str) -> dict:
    """Parse, fill in defaults and check."""
    spec = repaired(json.loads(text))
    for step in spec["steps"]:
        name = step.get("op")
        if name not in OPERATORS and name not in registry.names("table"):
            raise ValueError(f"unknown operator in step: {name}")
    step_order(spec)
    return spec


def import_spec(spec: Mapping) -> ImportSpec:
    imp, pre = spec["import"], spec["preprocess"]
    return ImportSpec(
        delimiter=imp["delimiter"], parser=imp["parser"], extensions=tuple(imp["extensions"]),
        exclude=tuple(imp["exclude"]), rename=pre["headers"], drop=tuple(pre["drop"]),
        combos=imp["combos"], derived=[(n, f, tuple(a)) for n, f, a in pre["derive"]],
        types=imp["types"], shared_header=imp["shared_header"],
    )


def run_filters(df: DataFrame, spec: Mapping) -> DataFrame:
    part = spec["filters"]
    if not part.get("use"):
        return df
    ranges = [RangeFilter(**r) for r in part["ranges"]]
    out = filter_table(df, ranges, part.get("categories"))
    return series_filter(out, part.get("series") or {})


def step_names(spec: Mapping) -> list[str]:
    return [step.get("as", f"{i + 1} {step['op']}") for i, step in enumerate(spec["steps"])]


def step_inputs(spec: Mapping, i: int) -> list[str]:
    """Names of the tables that a step reads."""
    step = spec["steps"][i]
    given = step.get("inputs")
    if given is not None:
        return list(given.values()) if isinstance(given, Mapping) else list(given)
    return [step.get("input") or (step_names(spec)[i - 1] if i else "data")]


def _producers(spec: Mapping) -> dict[str, int]:
    names = step_names(spec)
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise ValueError(f"several steps have one name: {sorted(twice)}")
    return {n: i for i, n in enumerate(names)}


def _source(table: str, made: Mapping[str, int]) -> int | None:
    """The step that makes a table; a step's several tables begin with its name."""
    if table in made:
        return made[table]
    longest = max((n for n in made if table.startswith(n + " ")), key=len, default=None)
    return None if longest is None else made[longest]


def step_order(spec: Mapping) -> list[int]:
    """Steps in an order in which every input is there; an unknown input, or steps that wait for each other, are errors."""
    made, given = _producers(spec), {"data", *spec.get("imports", {})}
    needs = {}
    for i in range(len(spec["steps"])):
        needs[i] = set()
        for table in step_inputs(spec, i):
            if table not in given:
                k = _source(table, made)
                if k is None:
                    raise ValueError(f"unknown input: {table}")
                needs[i].add(k)
    order: list[int] = []
    while len(order) < len(needs):
        ready = [i for i in needs if i not in order and needs[i] <= set(order)]
        if not ready:
            raise ValueError("steps wait for each other")
        order.append(ready[0])
    return order


def run_steps(df: DataFrame, spec: Mapping, others: Mapping[str, DataFrame] | None = None, held: list[DataFrame] | None = None) -> dict[str, DataFrame]:
    """Result tables by name; ``data`` is the input itself.  Tables that several steps read are persisted and put into ``held``."""
    tables: dict[str, DataFrame] = {"data": df, **(others or {})}
    uses = Counter(t for i in range(len(spec["steps"])) for t in set(step_inputs(spec, i)))
    names, unlisted = step_names(spec), set()

    def use(table: str) -> DataFrame:
        if table not in tables:
            raise ValueError(f"unknown input: {table}")
        if held is not None and uses[table] > 1 and not any(tables[table] is h for h in held):
            tables[table] = tables[table].persist(StorageLevel.MEMORY_AND_DISK)
            held.append(tables[table])
        return tables[table]

    for i in step_order(spec):
        step = spec["steps"][i]
        fn = OPERATORS.get(step["op"]) or registry.lookup("table", step["op"])
        sources = [use(t) for t in step_inputs(spec, i)]
        for source in sources:
            require(source, step.get("needs_categories", ()), step.get("needs_features", ()))
        given, args = step.get("inputs"), dict(step.get("args", {}))
        if "ranges" in args:
            args["ranges"] = [RangeFilter(**r) for r in args["ranges"]]
        if step["op"] == "concat_rows":
            labels = list(given) if isinstance(given, Mapping) else step_inputs(spec, i)
            result = fn(dict(zip(labels, sources)), **args)
        elif isinstance(given, Mapping):
            result = fn(**dict(zip(given, sources)), **args)
        else:
            result = fn(*sources, **args)
        if isinstance(result, tuple):
            found = [r for r in result if isinstance(r, DataFrame)]
            result = dict(zip(RESULTS.get(step["op"], range(1, len(found) + 1)), found))
            if len(result) == 1:
                result = next(iter(result.values()))
            else:
                # Later steps that name the step read its first table.
                tables[names[i]] = next(iter(result.values()))
        if isinstance(result, DataFrame):
            tables[names[i]] = result
        else:
            tables.update({f"{names[i]} {k}": v for k, v in result.items()})
            if step["op"] in RESULTS:
                unlisted.add(names[i])
    for name in unlisted:
        tables.pop(name, None)
    return tables


def run_job(spark: SparkSession, inputs: Sequence[str], spec: Mapping, held: list[DataFrame] | None = None) -> dict[str, DataFrame]:
    """Import, derive, filter, then the steps.  ``held`` receives the tables to unpersist when the results have been used.

    Imports of the same paths in the same way are one table.
    """
    read: list[tuple[list[str], dict, DataFrame]] = []

    def table(paths: Sequence[str], part: dict) -> DataFrame:
        for have, how, df in read:
            if (have, how) == (list(paths), part):
                return df
        df = run_filters(read_measurements(spark, list(paths), import_spec({**spec, "import": part})), spec)
        read.append((list(paths), part, df))
        return df

    others = {}
    for name, own in spec.get("imports", {}).items():
        others[name] = table(own["paths"], {**spec["import"], **{k: v for k, v in own.items() if k != "paths"}})
    return run_steps(table(inputs, spec["import"]), spec, others, held)


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Import measurement files and run a job specification.")
    parser.add_argument("-i", "--input", nargs="+", required=True, help="files or directories")
    parser.add_argument("-x", "--exclude", nargs="+", default=[], help="base names of files to leave out")
    parser.add_argument("-o", "--output", help="directory for the result tables")
    parser.add_argument("-p", "--parser", help="path preset")
    parser.add_argument("-c", "--config", help="job specification (JSON); its parser wins over -p")
    parser.add_argument("-l", "--log", default="WARN", help="Spark log level")
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> None:
    args = arguments(argv)
    spark = SparkSession.builder.appName("measureframe").getOrCreate()
    spark.sparkContext.setLogLevel(args.log.upper())
    text = "{}"
    if args.config:
        text = "\n".join(r["value"] for r in spark.read.text(args.config).collect())
    given = json.loads(text)
    spec = load_spec(text)
    if args.parser and "parser" not in given.get("import", {}):
        spec = update(spec, ("import", "parser"), args.parser)
    if args.exclude:
        spec = update(spec, ("import", "exclude"), [*spec["import"]["exclude"], *args.exclude])
    held: list[DataFrame] = []
    tables = run_job(spark, args.input, spec, held)
    target = args.output or spec["output"]["path"]
    if target is None:
        raise SystemExit("no output: give -o or output.path")
    if spec["steps"]:
        given = {"data", *spec["imports"]}
        write_results({k: v for k, v in tables.items() if k not in given}, target, spec["output"]["format"])
    else:
        write_table(tables["data"], target, spec["output"]["format"])
    for table in held:
        table.unpersist()


if __name__ == "__main__":
    main()
