import os
import re

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_machine_local_or_unbounded_habits():
    """No local checkpoints, no cross joins, no row-at-a-time functions in the package."""
    for folder, _, files in os.walk(os.path.join(ROOT, "measureframe")):
        for name in files:
            if name.endswith(".py"):
                code = open(os.path.join(folder, name)).read()
                assert not re.search(r"localCheckpoint|crossJoin|\.conf\.set\(|F\.udf\(|toPandas\(", code), name
