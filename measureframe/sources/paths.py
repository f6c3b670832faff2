"""Category labels from file paths."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from measureframe.roles import as_category, q

# Where a label stands in ".../Cell line/Compartment/name-a-b-c.ext".
_PARENT2 = r".*/(.*?)/.*/"
_PARENT1 = r".*/(.*?)/"
_PART2 = r".*/.*?[_-](.*?)[_-]"
_PART3 = r".*/.*?[_-].*?[_-](.*?)[_-]"
_PART3_NUMBER = r".*/.*?[_-].*?[_-](\d*?)\."
_PART4_NUMBER = r".*/.*?[_-].*?[_-].*?[_-](\d*?)\."
_PART4 = r".*/.*?[_-].*?[_-].*?[_-](.*?)\."

PATH_PRESETS: dict[str, dict[str, str]] = {
    "none": {},
    "celltype_compartment_fov_treatment_cell": {
        "Cell line": _PARENT2, "Compartment": _PARENT1,
        "FOV": _PART2, "Treatment": _PART3, "Cell": _PART4_NUMBER,
    },
    "compartment_fov_treatment_cell": {
        "Compartment": _PARENT1, "FOV": _PART2, "Treatment": _PART3, "Cell": _PART4_NUMBER,
    },
    "compartment_treatment_fov_cell": {
        "Compartment": _PARENT1, "Treatment": _PART2, "FOV": _PART3, "Cell": _PART4_NUMBER,
    },
    "fov_treatment_cell": {"FOV": _PART2, "Treatment": _PART3, "Cell": _PART4_NUMBER},
    "treatment_fov_cell": {"Treatment": _PART2, "FOV": _PART3, "Cell": _PART4_NUMBER},
    "treatment_fov_time": {"Treatment": _PART2, "FOV": _PART3, "Time": _PART4_NUMBER},
    "treatment_time": {"Treatment": _PART2, "Time": _PART3_NUMBER},
    "fov_time_well": {"FOV": _PART2, "Time": _PART3, "Well": _PART4},
}


def path_patterns(preset: str | Mapping[str, str]) -> dict[str, str]:
    """Category patterns of a preset name, or a user's own ``{category: regex}``."""
    return dict(PATH_PRESETS[preset] if isinstance(preset, str) else preset)


def plain_path(uri: Column) -> Column:
    """``file:///a%20b`` as written on disk; a plus sign stays a plus sign."""
    local = F.regexp_replace(uri, r"^file:/+", "/")
    return F.url_decode(F.replace(local, F.lit("+"), F.lit("%2B")))


def path_label(path: Column, pattern: str) -> Column:
    """First group of ``pattern``: null without a match, ``?`` for an empty label."""
    found = F.regexp_extract(path, pattern, 1)
    return F.when(path.rlike(pattern), F.when(found == "", F.lit("?")).otherwise(found))


def parse_path(
    df: DataFrame, path: str, preset: str | Mapping[str, str], directory_and_file: bool = True
) -> DataFrame:
    """Append one category column per pattern, read from the path column."""
    # The no-parsing preset adds nothing at all, not even the directory.
    if preset == "none":
        return df
    raw = q(path)
    slashed = F.translate(raw, "\\", "/")
    made = {}
    if directory_and_file:
        made["Directory"] = F.regexp_extract(raw, r"^(.*)/[^/]*$", 1)
        made["File"] = F.regexp_extract(raw, r"([^/]*)$", 1)
    made.update({c: path_label(slashed, p) for c, p in path_patterns(preset).items()})
    keep = [q(c) for c in df.columns if c not in made]
    return df.select(*keep, *[as_category(col, name) for name, col in made.items()])
