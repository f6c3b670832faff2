"""Ranks of several features at once: one range partitioning of all distinct values, carried totals, ranks back beside the distinct rows."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from measureframe.roles import q

#: Distinct values of all features that one task sorts, on average.
TASK_VALUES = 1_000_000
#: Distinct values of a feature, as counted, whose ranks go to every task.
_FEW_VALUES = 50_000

# Workers get these helpers by value, so they need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Ranked:
    """``rows`` has a row for each distinct row with any value, and its ``_count``; call ``release`` when its plans have run.

    ``counts[i, j]`` are the rows with values of features i and j.  ``partners[i]`` are the features for which i has
    ranks of its own: itself, and those with missing values.
    """

    rows: DataFrame
    counts: np.ndarray
    partners: list[list[int]]
    _held: tuple[DataFrame, ...]

    def partner(self, i: int, j: int) -> int:
        """The feature whose missing values decide the ranks of i beside j."""
        return j if j in self.partners[i] else i

    def average(self, i: int, j: int) -> Column:
        """Average rank (from 1) of feature i among the rows that also have j."""
        return F.col(f"_avg{i}_{self.partner(i, j)}")

    def release(self) -> None:
        for used in self._held:
            used.unpersist()


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each run of equal values, the run of each place)."""
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    return np.flatnonzero(new), np.cumsum(new) - 1


def _blocks(batches):
    """The values of a task, feature by feature: (feature, values, masks, counts), sorted by value."""
    parts = [tuple(t.column(k).to_numpy(zero_copy_only=False) for k in range(4)) for t in batches]
    if not parts:
        return
    feature, value, mask, count = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((value, feature))
    starts, _ = _runs(feature[order])
    for part in np.split(order, starts[1:]):
        if len(part):
            yield int(feature[part[0]]), value[part], mask[part], count[part]


def _present(mask: np.ndarray, count: np.ndarray, partner: int) -> np.ndarray:
    return (mask >> partner & 1) * count


def _totals(partners):
    def run(batches):
        task, out = TaskContext.get().partitionId(), []
        for i, value, mask, count in _blocks(batches):
            first, _ = _runs(value)
            for m in partners[i]:
                per = np.add.reduceat(_present(mask, count, m), first)
                out.append((task, i, m, int(per.sum()), len(first)))
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([
            *(pa.array(c, pa.int32()) for c in columns[:3]), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())],
            names=["task", "i", "m", "n", "values"])

    return run


def _ranks(partners, before, width):
    """Rows (i, x, ranks), one for each distinct value: places are counted on from what lies in the tasks before."""
    def run(batches):
        task = TaskContext.get().partitionId()
        for i, value, mask, count in _blocks(batches):
            first, _ = _runs(value)
            ranks = np.full((len(first), width), np.nan)
            for k, m in enumerate(partners[i]):
                per = np.add.reduceat(_present(mask, count, m), first)
                upto = np.cumsum(per) + before.get((task, i, m), 0)
                ranks[:, k] = upto - (per - 1) / 2
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(first), i, np.int32)), pa.array(value[first]), *(pa.array(ranks[:, k], mask=np.isnan(ranks[:, k])) for k in range(width))],
                names=["i", "x", *(f"r{k}" for k in range(width))])

    return run


def ranked(df: DataFrame, features: Sequence[str]) -> Ranked:
    """Average ranks of every feature, pairwise complete, on the distinct rows.

    Equal rows are counted first, and then equal (feature, value), so a value that many rows share is one entry for each
    pattern of missing values.  The entries are range-partitioned together, once; equal values meet in one task.  A task
    tells how many rows of each feature it has, a few numbers that the driver adds up in the order of the tasks, and
    counts its own ranks on from there.  A join for each feature brings the ranks back, those of few values (as
    counted) by broadcast.  A missing value has no rank.
    """
    n = len(features)
    if n > 62:
        raise ValueError("at most 62 features are ranked together")
    known = lambda x: F.when(~F.isnan(x), x)
    # + 0.0: a negative zero is a zero.
    data = df.select(*[(known(q(f).cast("double")) + 0.0).alias(f"_x{i}") for i, f in enumerate(features)])
    cells = data.groupBy(*data.columns).agg(F.count(F.lit(1)).alias("_count")).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = cells.agg(F.sum("_count"), *[F.sum(F.when(F.col(c).isNotNull(), F.col("_count"))) for c in data.columns]).first()
    sizes = [size or 0 for size in sizes]
    partners = [[i, *(j for j in range(n) if j != i and sizes[1 + j] < sizes[0])] for i in range(n)]
    mask = sum((F.when(F.col(f"_x{i}").isNotNull(), F.lit(1 << i)).otherwise(0).cast("long") for i in range(n)), F.lit(0).cast("long"))
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_x{i}").alias("x")) for i in range(n)])
    values = cells.select(mask.alias("mask"), "_count", F.explode(entries).alias("_e")).select("_e.*", "mask", "_count").filter("x is not null")
    values = values.groupBy("i", "x", "mask").agg(F.sum("_count").alias("count"))
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, -(-sum(sizes[1:]) // TASK_VALUES))
    held = values.repartitionByRange(parts, "i", "x").persist(StorageLevel.MEMORY_AND_DISK)

    counts, distinct = np.zeros((n, n), np.int64), [0] * n
    before: dict[tuple[int, int, int], int] = {}
    # One row for each task and feature that it has, and partner.
    totals = held.mapInArrow(_totals(partners), "task int, i int, m int, n bigint, values bigint")
    for r in sorted(totals.collect(), key=lambda r: r.task):
        before[r.task, r.i, r.m] = int(counts[r.i, r.m])
        counts[r.i, r.m] += r.n
        distinct[r.i] += r["values"] if r.m == r.i else 0
    for i in range(n):
        for j in range(n):
            if j not in partners[i]:
                counts[i, j] = counts[i, i]
    width = max(map(len, partners), default=1)
    schema = "i int, x double, " + ", ".join(f"r{k} double" for k in range(width))
    found = held.mapInArrow(_ranks(partners, before, width), schema).persist(StorageLevel.MEMORY_AND_DISK)
    wide = cells
    for i in range(n):
        own = found.filter(F.col("i") == i).select(
            F.col("x").alias(f"_v{i}"), *[F.col(f"r{k}").alias(f"_avg{i}_{m}") for k, m in enumerate(partners[i])])
        wide = wide.join(F.broadcast(own) if distinct[i] <= _FEW_VALUES else own, F.col(f"_x{i}") == F.col(f"_v{i}"), "left")
    rank = lambda i, m: F.when(F.col(f"_x{m}").isNotNull(), F.col(f"_avg{i}_{m}")).alias(f"_avg{i}_{m}")
    rows = wide.select("_count", *[rank(i, m) for i in range(n) for m in partners[i]])
    return Ranked(rows, counts, partners, (cells, held, found))
