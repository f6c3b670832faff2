"""Correlation matrices and two-sample Kolmogorov-Smirnov tests."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from decimal import Decimal
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from measureframe.plans.ordering import cut_points, join_on, running_totals, slice_count, slice_of, task_rows
from measureframe.plans.ranking import ranked
from measureframe.roles import as_category, as_list, drop_missing, q

# c(alpha) of the critical distance.
KS_COEFFICIENT = {0.10: 1.22, 0.05: 1.36, 0.025: 1.48, 0.01: 1.63, 0.005: 1.73, 0.001: 1.95}
KS_TERMS = 100
#: P(D >= d) is at most 2.17 exp(-2 lam^2); beyond this lam, no double but 0 is nearer to it.
_KS_NOTHING = 19.4
#: A band of so many cells is wide enough for a test to be computed alone.
_KS_WIDE = 256
#: Distinct values whose shares are held at once, for all labels.
_KS_VALUES = 4096
#: Values that are dealt out at once.
_BLOCK_VALUES = 2_000_000
#: A cell of slices has its rows ``c``; the sums of a slice have the others.
_SCORES = "pair int, x int, y int, c bigint, score decimal(38,0), x_ties decimal(38,0), y_ties decimal(38,0)"


# Workers get these helpers by value, so they need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def correlation_matrix(df: DataFrame, features: Sequence[str], method: str = "pearson") -> DataFrame:
    """``Feature`` and one column per feature; pairwise complete rows."""
    feats = list(features)
    if method == "pearson":
        return _square(_pearson(df, feats), feats)
    if method == "spearman":
        return _spearman(df, feats)
    if method == "kendall":
        return _kendall(df, feats)
    raise ValueError("method must be pearson, spearman or kendall")


def _pair(i: int, j: int) -> str:
    return f"_c{min(i, j)}_{max(i, j)}"


def _square(row: DataFrame, feats: Sequence[str]) -> DataFrame:
    """One row with a column per pair, as a symmetric matrix."""
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("Feature"), *[F.col(_pair(i, j)).alias(b) for j, b in enumerate(feats)])
        for i, a in enumerate(feats)
    ])))


def pair_correlations(
    df: DataFrame, pairs: dict[str, tuple[str, str]], centres: dict[str, float] | None = None, count: str | None = None
) -> DataFrame:
    """One row with the correlation of each named pair of columns, pairwise complete.

    Tasks reduce their rows to the moments of each pair with matrix products, so the
    shuffle carries one row per pair and task.  Values are centred first (on the column
    means, unless the caller knows the ``centres`` and saves that pass), which keeps the
    differences of squares exact enough.  A row stands for as many as its ``count`` column says.
    """
    cols = sorted({c for p in pairs.values() for c in p})
    if centres is None:
        means = df.agg(F.struct(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(cols)])).scalar()
        middle = [means[f"m{i}"] for i in range(len(cols))]
    else:
        middle = [F.lit(float(centres[c])) for c in cols]
    centred = df.select(*[(q(c) - mid).alias(f"_z{i}") for i, (c, mid) in enumerate(zip(cols, middle))], (q(count) if count else F.lit(1)).alias("_weight"))
    names = list(pairs)
    left = [cols.index(pairs[p][0]) for p in names]
    right = [cols.index(pairs[p][1]) for p in names]

    def moments(batches):
        total = None
        for pdf in batches:
            z, weight = np.split(pdf.to_numpy(dtype=np.float64, na_value=np.nan), [len(cols)], axis=1)
            mask = ~np.isnan(z)
            z = np.where(mask, z, 0.0)
            mask = mask.astype(np.float64)
            often, zs = mask * weight, z * weight
            n, s, ss, cross = mask.T @ often, zs.T @ mask, (zs * z).T @ mask, zs.T @ z
            part = np.stack([
                n[left, right], s[left, right], s[right, left], ss[left, right], ss[right, left], cross[left, right]
            ])
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"pair": names, **{k: total[i] for i, k in enumerate(_MOMENTS)}})

    schema = "pair string, " + ", ".join(f"{k} double" for k in _MOMENTS)
    sums = centred.mapInPandas(moments, schema).groupBy("pair").agg(*[F.sum(k).alias(k) for k in _MOMENTS])
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") ** 2, n * F.col("syy") - F.col("sy") ** 2
    # Below the rounding error of the squares, a column has no spread.
    some = (vx > n * F.col("sxx") * 1e-13) & (vy > n * F.col("syy") * 1e-13)
    r = F.try_divide(n * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(vx) * F.sqrt(vy))
    inside = F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)
    return sums.select("pair", F.when(some, inside).alias("r")).agg(*[
        F.max(F.when(F.col("pair") == p, F.col("r"))).alias(p) for p in names
    ])


_MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _pearson(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    data = df.select(*[q(f).cast("double").alias(f"_x{i}") for i, f in enumerate(feats)])
    return pair_correlations(data, {
        _pair(i, j): (f"_x{i}", f"_x{j}") for i in range(len(feats)) for j in range(i, len(feats))
    })


def _spearman(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """Pearson correlation of average ranks; a rank depends on which rows the partner has values for."""
    n = len(feats)
    found = ranked(df, feats)
    names = sorted({(i, found.partner(i, j)) for i in range(n) for j in range(n)})
    # The mean rank of k rows is (k + 1) / 2, whatever the ties.
    centres = {f"_avg{i}_{m}": (found.counts[i, m] + 1) / 2 for i, m in names}
    row = pair_correlations(found.rows, {
        _pair(i, j): (f"_avg{i}_{found.partner(i, j)}", f"_avg{j}_{found.partner(j, i)}") for i in range(n) for j in range(i, n)
    }, centres, "_count").first()
    found.release()
    return _table(df, feats, {(i, j): row[_pair(i, j)] for i in range(n) for j in range(n)})


def _kendall(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """Tau-b for every pair of features, from one shuffle of the rows.

    Cut points deal the values of each feature into slices that a task can hold; a value with a slice's share of the
    rows is a slice of its own, in which there is nothing to compare.  Two points (x, y) lie in the same slice of x, or in
    different ones but the same slice of y, or in different slices of both.  The first are compared in that slice of x
    by y, the second in that slice of y by the number of their slice of x, both by ``concordance``; the last by the
    rows of each pair of slices, bit by bit.  So a row is sent once for each feature in which it does not lie in a slice of one value,
    in blocks, and no pair of points is ever formed.
    """
    n = len(feats)
    pairs = list(combinations(range(n), 2))
    known = lambda x: F.when(~F.isnan(x), x)
    # + 0.0: a negative zero is a zero.
    data = df.select(*[(known(q(f).cast("double")) + 0.0).alias(f"_x{i}") for i, f in enumerate(feats)])
    found = {}
    if pairs:
        rows = data.count()
        cuts = cut_points(data, data.columns, slice_count(df, rows)) if rows > max(2, task_rows(df) // 2) else {}
        slices = [_Slices(cuts.get(c, [])) for c in data.columns]
        dealt = data.mapInArrow(_deal(slices, pairs), "part int, slice int, cells binary")
        scored = dealt.groupBy("part", "slice").applyInArrow(_slice_scores(slices, pairs), _SCORES).persist(StorageLevel.MEMORY_AND_DISK)
        cells = scored.filter("c is not null")
        score = scored.select("pair", "c", "score", "x_ties", "y_ties")
        for side in ("x", "y"):
            # All rows with a value that is a slice of its own.
            alone = cells.filter(F.col(side) % 2 == 1).groupBy("pair", side).agg(F.sum("c").cast("decimal(18,0)").alias("t"))
            score = score.unionByName(alone.select("pair", (F.col("t") * (F.col("t") - 1) / 2).cast("decimal(38,0)").alias(f"{side}_ties")), True)
        if cuts:
            score = score.unionByName(_across_slices(cells, max(s.count for s in slices).bit_length()), True)
        found = {r.pair: r for r in score.groupBy("pair").agg(*[F.sum(k).alias(k) for k in ("c", "score", "x_ties", "y_ties")]).collect()}
        scored.unpersist()
    taus = {(i, i): 1.0 for i in range(n)}
    for k, (i, j) in enumerate(pairs):
        r = found.get(k)
        m, score, *ties = (int(v or 0) for v in r[1:]) if r else (0, 0, 0, 0)
        spread = math.prod(math.sqrt(m * (m - 1) // 2 - t) for t in ties)
        taus[i, j] = taus[j, i] = score / spread if spread else None
    return _table(df, feats, taus)


def _table(df: DataFrame, feats: Sequence[str], values: dict) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(f, *(values[i, j] for j in range(len(feats)))) for i, f in enumerate(feats)],
        T.StructType([T.StructField("Feature", T.StringType(), False), *(T.StructField(f, T.DoubleType()) for f in feats)]))


def concordance(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> int:
    """Concordant minus discordant pairs of points with multiplicities; ties in x or y count for nothing.

    Bit by bit of y, from the highest: among points with one prefix, those with a 1 are compared in x with those
    with a 0.  Points stay sorted by x inside a prefix.
    """
    y = np.unique(y, return_inverse=True)[1]
    order = np.argsort(x, kind="stable")
    x, y, c = x[order], y[order], c[order].astype(np.int64)
    score = 0
    for level in range(int(y.max()).bit_length() - 1, -1, -1) if len(y) else ():
        prefix, one = y >> (level + 1), (y >> level) & 1
        if level + 1 < int(y.max()).bit_length():
            order = np.argsort(prefix, kind="stable")
            x, y, c, prefix, one = x[order], y[order], c[order], prefix[order], one[order]
        zeros = np.concatenate([[0], np.cumsum(np.where(one == 0, c, 0))])
        first = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (x[1:] != x[:-1])]))
        ends = np.append(first[1:], len(x))
        bounds = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        part = np.searchsorted(bounds, first, side="right") - 1
        begin, end = zeros[bounds][part], zeros[np.append(bounds[1:], len(x))][part]
        ones = np.add.reduceat(np.where(one == 1, c, 0), first)
        weight = (zeros[first] - begin) - (end - zeros[ends])
        # Products of counts may exceed 64 bits in sum, not each.
        score += sum(int(s) for s in np.add.reduceat(ones * weight, np.arange(0, len(ones), 1024)))
    return score


class _Slices:
    """Numbers of the slices that cut points make, in the order of values: odd ones have a single value, missing is -1."""

    def __init__(self, cuts: Sequence[float]):
        self.edges, often = np.unique(np.array(cuts, np.float64), return_counts=True)
        self.alone = np.append(often > 1, False)
        self.count = 2 * len(self.edges) + 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.edges, x)
        alone = self.alone[at] & (np.append(self.edges, np.nan)[at] == x)
        return np.where(np.isnan(x), -1, 2 * at + alone)


def _stretches(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of equal values."""
    new = np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(sorted_values)))


def _deal(slices: Sequence[_Slices], pairs: Sequence[tuple[int, int]]):
    """Blocks (part, slice, cells): part i is feature i, with the values of all features of a slice's rows, column by column; beyond
    the features there is a part for each pair, with (slice of y, rows) of a slice of x, where both have a single value."""
    n = len(slices)

    def run(batches):
        for x in _column_blocks(batches, n):
            numbers = [cut(v) for cut, v in zip(slices, x)]
            part, number, cells = [], [], []
            for i in range(n):
                own = np.flatnonzero(numbers[i] & 1 == 0)
                own = own[np.argsort(numbers[i][own], kind="stable")]
                first, size = _stretches(numbers[i][own])
                for a, k in zip(first, size):
                    number.append(int(numbers[i][own[a]]))
                    cells.append(x[:, own[a:a + k]].tobytes())
                part += [i] * len(first)
            for k, (i, j) in enumerate(pairs):
                both = (numbers[i] >= 0) & (numbers[j] >= 0) & (numbers[i] & numbers[j] & 1 == 1)
                kinds, count = np.unique(numbers[i][both] * slices[j].count + numbers[j][both], return_counts=True)
                left, right = np.divmod(kinds, slices[j].count)
                for a, size in zip(*_stretches(left)):
                    number.append(int(left[a]))
                    cells.append(np.stack([right[a:a + size], count[a:a + size]]).astype(np.int64).tobytes())
                    part.append(n + k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(number, pa.int32()), pa.array(cells, pa.binary())], names=["part", "slice", "cells"])

    return run


def _column_blocks(batches, n: int):
    """The values of many batches: arrays with a row for each column, NaN where missing."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows * n >= _BLOCK_VALUES:
            yield _columns(held)
            held, rows = [], 0
    if rows:
        yield _columns(held)


def _columns(batches) -> np.ndarray:
    return np.stack([c.to_numpy() for c in pa.Table.from_batches(batches).columns])


def _slice_scores(slices: Sequence[_Slices], pairs: Sequence[tuple[int, int]]):
    """Rows of a slice: for each pair its score and ties, and its cells (slice of x, slice of y, rows) as far as no other slice has them."""
    n, place = len(slices), {p: k for k, p in enumerate(pairs)}

    def run(group: pa.Table) -> pa.Table:
        part, number = group.column("part")[0].as_py(), group.column("slice")[0].as_py()
        blocks = [np.frombuffer(c.as_buffer(), np.float64 if part < n else np.int64) for c in group.column("cells")]
        cells, sums = [], []
        if part >= n:
            right, count = np.concatenate([b.reshape(2, -1) for b in blocks], axis=1)
            order = np.argsort(right, kind="stable")
            first, _ = _stretches(right[order])
            cells.append((part - n, number, right[order][first], np.add.reduceat(count[order], first)))
        else:
            x = np.concatenate([b.reshape(n, -1) for b in blocks], axis=1)
            x = x[:, np.argsort(x[part], kind="stable")]
            for j in range(n):
                both = np.flatnonzero(~np.isnan(x[j]))
                if j == part or not len(both):
                    continue
                own, other = x[part][both], x[j][both]
                size = _stretches(own)[1]
                ties = int((size * (size - 1) // 2).sum())
                there, count = np.unique(slices[j](other), return_counts=True)
                once = np.ones(len(own), np.int64)
                if part < j:
                    k = place[part, j]
                    sums.append((k, concordance(own, other, once), ties, 0))
                    cells.append((k, number, there, count))
                else:
                    k, alone = place[j, part], there % 2 == 1
                    sums.append((k, concordance(own, slices[j](other), once), 0, ties))
                    cells.append((k, there[alone], number, count[alone]))
        pair, left, right, count = ([np.broadcast_to(v, len(c[3])) for c in cells for v in (c[i],)] for i in range(4))
        found = [pa.array(np.concatenate(v) if v else [], t) for v, t in zip((pair, left, right, count), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
        nothing = lambda k, t: pa.nulls(k, t)
        whole = pa.decimal128(38, 0)
        names = ["pair", "x", "y", "c", "score", "x_ties", "y_ties"]
        return pa.concat_tables([
            pa.table([*found, *(nothing(len(found[0]), whole) for _ in range(3))], names=names),
            pa.table([pa.array([r[0] for r in sums], pa.int32()), *(nothing(len(sums), t) for t in (pa.int32(), pa.int32(), pa.int64())), *(pa.array([Decimal(r[i]) for r in sums], whole) for i in (1, 2, 3))], names=names)])

    return run


def _across_slices(cells: DataFrame, bits: int) -> DataFrame:
    """(pair, score) of the points in different slices of x and of y, bit by bit of the latter's number.

    Numbers agree in the leading bits up to one bit, so for each bit and each common prefix those with a 1 are compared in x with those with
    a 0, by a running count along x.
    """
    spread = cells.select("pair", "x", "y", "c", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("level"))
    bit = F.expr("shiftright(y, level) & 1")
    sides = spread.groupBy("pair", "level", F.expr("shiftright(y, level + 1)").alias("prefix"), "x").agg(
        F.sum(F.when(bit == 0, F.col("c")).otherwise(0)).alias("zero"), F.sum(F.when(bit == 1, F.col("c")).otherwise(0)).alias("one"))
    # Along x there are no more rows than slices.
    run = running_totals(sides, ["pair", "level", "prefix"], "x", ["zero"])
    weight = 2 * F.col("zero_upto") - F.col("zero") - F.col("zero_total")
    return run.groupBy("pair").agg(F.sum(F.col("one").cast("decimal(18,0)") * weight.cast("decimal(18,0)")).cast("decimal(38,0)").alias("score"))


def kendall_tau(df: DataFrame, x: str, y: str) -> DataFrame:
    """Tau-b of two columns: (tau)."""
    return _kendall(df, [x, y]).filter(F.col("Feature") == x).select(q(y).alias("tau"))


def ks_test(
    df: DataFrame,
    feature: str,
    comparison: str,
    grouping: str | Sequence[str] = (),
    alpha: float = 0.05,
    pvalue: str = "asymptotic",
    values: Sequence[str] | None = None,
) -> DataFrame:
    """Two-sample test for every pair of ``comparison`` labels inside each group.

    ``pvalue``: ``asymptotic`` (Kolmogorov series) or ``exact`` (lattice paths).

    Values are counted per label first.  Each slice of the value axis then gets the counts below it,
    forms the shares of all labels at its values, and gives the largest distance of each pair
    that it sees, so pairs of labels never meet as rows before that maximum, and labels
    stay off the driver.
    """
    if pvalue not in ("asymptotic", "exact"):
        raise ValueError("pvalue must be asymptotic or exact")
    keys = [k for k in as_list(grouping) if k != comparison]
    names = [f"_k{i}" for i in range(len(keys))]
    data = drop_missing(
        df.select(*[q(k) for k in keys], q(comparison), q(feature).cast("double").alias("_x")), [*keys, comparison, "_x"]
    ).select(*[q(k).alias(n) for k, n in zip(keys, names)], q(comparison).alias("_label"), "_x")
    if values is not None:
        data = data.filter(F.col("_label").isin(list(values)))
    sizes = data.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    cuts = cut_points(data, ["_x"], slice_count(df, sizes))["_x"] if sizes > task_rows(df) else []
    counts = data.groupBy(*names, "_label", "_x").agg(F.count(F.lit(1)).alias("_n")).withColumn("_slice", slice_of(F.col("_x"), cuts))
    inside = counts.groupBy(*names, "_label", "_slice").agg(F.sum("_n").alias("_n"))
    # One row per group, slice and label: every label has its share in every slice.
    places = inside.select(*names, "_slice").distinct()
    labels = inside.groupBy(*names, "_label").agg(F.sum("_n").alias("_total"))
    grid = places.join(labels, names) if names else _beside(places, labels)
    by_label = W.partitionBy(*names, "_label").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    before = join_on(grid, inside, [*names, "_label", "_slice"], "left").select(
        *[F.col(n).alias(f"_g{n}") for n in names], F.col("_label").alias("_g_label"), F.col("_slice").alias("_g_slice"), "_total", F.coalesce(F.sum("_n").over(by_label), F.lit(0)).alias("_before"))
    order = {v: i for i, v in enumerate(values)} if values is not None else None

    def distances(counted: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        start = start.sort_values("_g_label", key=lambda c: c.map(order) if order else c)
        found, total = list(start["_g_label"]), start["_total"].to_numpy(np.float64)
        xs, at = np.unique(counted["_x"].to_numpy(), return_inverse=True)
        where = pd.Index(found).get_indexer(counted["_label"])
        n, base = counted["_n"].to_numpy(), start["_before"].to_numpy(np.float64)
        best = np.zeros((len(found), len(found)))
        for first in range(0, len(xs), _KS_VALUES):
            own = (at >= first) & (at < first + _KS_VALUES)
            upto = np.zeros((min(_KS_VALUES, len(xs) - first), len(found)))
            np.add.at(upto, (at[own] - first, where[own]), n[own])
            upto = np.cumsum(upto, axis=0) + base
            base, share = upto[-1], upto / total
            for i in range(len(found) - 1):
                best[i, i + 1:] = np.maximum(best[i, i + 1:], np.abs(share[:, i + 1:] - share[:, i:i + 1]).max(axis=0))
        i, j = np.triu_indices(len(found), 1)
        out = {k: [start[f"_g{k}"].iloc[0]] * len(i) for k in names}
        label = pd.Series(found, dtype=start["_g_label"].dtype)
        return pd.DataFrame({**out, "_a": label.iloc[i].array, "_b": label.iloc[j].array, "_n1": total[i].astype(np.int64), "_n2": total[j].astype(np.int64), "_d": best[i, j]})

    kinds = {f.name: f.dataType for f in data.schema}
    schema = T.StructType([
        *[T.StructField(n, kinds[n]) for n in names], T.StructField("_a", kinds["_label"]), T.StructField("_b", kinds["_label"]),
        T.StructField("_n1", T.LongType()), T.StructField("_n2", T.LongType()), T.StructField("_d", T.DoubleType()),
    ])
    by = [*names, "_slice"]
    best = counts.groupBy(*by).cogroup(before.groupBy(*[f"_g{n}" for n in by])).applyInPandas(distances, schema)
    found = best.groupBy(*names, "_a", "_b").agg(F.max("_n1").alias("_n1"), F.max("_n2").alias("_n2"), F.max("_d").alias("_d"))
    found = found.select(*[q(n).alias(k) for n, k in zip(names, keys)], F.col("_a").cast("string").alias("_a"), F.col("_b").cast("string").alias("_b"), "_n1", "_n2", "_d")
    return _ks_columns(found, keys, comparison, alpha, pvalue)


def _beside(places: DataFrame, labels: DataFrame) -> DataFrame:
    """Every slice with every label, where there is a single group; the result has their pairs, so the labels are few."""
    listed = labels.agg(F.collect_list(F.struct("_label", "_total"))).scalar()
    return places.withColumn("_all", listed).select("_slice", F.inline("_all"))


def _ks_columns(found: DataFrame, keys: Sequence[str], comparison: str, alpha: float, pvalue: str) -> DataFrame:
    n1, n2, d = F.col("_n1").cast("double"), F.col("_n2").cast("double"), F.col("_d")
    exact = pvalue == "exact"
    if exact:
        # Few rows with long work: dealt out, in a number that AQE leaves alone.
        found = found.repartition(8 * found.sparkSession.sparkContext.defaultParallelism, *[q(k) for k in keys], "_a", "_b")
    found = found.withColumn("_p", exact_tail()(d, n1, n2) if exact else kolmogorov_tail(d * F.sqrt(n1 * n2 / (n1 + n2))))
    critical = F.lit(KS_COEFFICIENT[alpha]) * F.sqrt((n1 + n2) / (n1 * n2))
    apart = (d > critical) & (F.col("_p") < alpha)
    head = [as_category(q(k), k) for k in keys] or [as_category(F.lit("none"), "Grouping")]
    return found.select(
        *head,
        as_category(F.col("_a"), f"{comparison} 1"),
        as_category(F.col("_b"), f"{comparison} 2"),
        as_category(F.concat("_a", F.lit("-"), "_b"), f"{comparison} 1 & 2"),
        as_category(F.when(apart, "Yes").otherwise("No"), f"dissimilar (<{alpha})"),
        F.col("_n1").alias(f"n ({comparison} 1)"),
        F.col("_n2").alias(f"n ({comparison} 2)"),
        F.col("_p").alias("p-values"),
        F.col("_d").alias("statistic"),
        critical.alias(f"critical D ({alpha})"),
    )


def kolmogorov_tail(lam: Column) -> Column:
    """2 * sum (-1)^(k-1) exp(-2 k^2 lam^2), inside [0, 1]; 1 below lam = 0.2."""
    ks = F.lit(list(range(1, KS_TERMS + 1)))
    total = F.aggregate(
        ks, F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(2.0) * total)))


def lattice_tails(d: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Exact P(D >= d) of many tests at once, by lattice paths from (0, 0) to (m, n).

    Diagonal by diagonal, for all tests together, each cell of the band that the distance leaves has the share of the
    paths to it that have left the band; a cell outside has 1.  Only the band is held, at most about
    d * max(m, n) cells wide, and its lower end moves by at most one cell a diagonal.
    """
    out = np.ones(len(d))
    g = np.gcd(m, n)
    mg, ng = m // g, n // g
    steps = np.rint(d * mg * n).astype(np.int64)
    live = np.flatnonzero(steps > 0)
    live = live[np.argsort((m + n)[live], kind="stable")]
    if not len(live):
        return out
    m, n, mg, ng, steps = (x[live].astype(np.int64) for x in (m, n, mg, ng, steps))

    def low(t: int) -> np.ndarray:
        return np.maximum(np.maximum(0, t - m), (t * ng - steps) // (mg + ng) + 1)

    def high(t: int) -> np.ndarray:
        return np.minimum(np.minimum(n, t), (t * ng + steps - 1) // (mg + ng))

    width = int((2 * steps // (mg + ng)).max()) + 2
    at = np.arange(width)
    share = np.ones((len(m), width + 2))
    share[:, 1] = 0.0  # the cell (0, 0), one place behind the one below the band
    before = low(0)
    for t in range(1, int((m + n).max()) + 1):
        first = low(t)
        j = first[:, None] + at
        moved = (first > before)[:, None]
        across = np.where(moved, share[:, 2:], share[:, 1:-1])
        up = np.where(moved, share[:, 1:-1], share[:, :-2])
        new = (across * (t - j) + up * j) / t
        new[j > high(t)[:, None]] = 1.0
        share[:, 1:-1] = new
        before = first
        done = int(np.searchsorted(m + n, t, side="right"))
        if done:
            out[live[:done]] = share[np.arange(done), 1 + n[:done] - first[:done]]
            live, m, n, mg, ng, steps, share, before = (x[done:] for x in (live, m, n, mg, ng, steps, share, before))
    return out


def lattice_tail(steps: int, m: int, n: int, mg: int, ng: int) -> float:
    """One test of ``lattice_tails`` with a wide band: the same cells, updated in place along plain slices."""
    t = np.arange(1, m + n + 1)
    low = np.concatenate([[0], np.maximum(np.maximum(0, t - m), (t * ng - steps) // (mg + ng) + 1)])
    high = np.concatenate([[0], np.minimum(np.minimum(n, t), (t * ng + steps - 1) // (mg + ng))])
    size = int((high - low).max()) + 3
    # The cell j of a diagonal is at j - low + 1; both neighbours of the band have 1.
    share, new, other = np.ones(size), np.ones(size), np.empty(size)
    share[1] = 0.0
    places = np.arange(n + 2, dtype=np.float64)
    firsts, lasts = low.tolist(), high.tolist()
    for t in range(1, m + n + 1):
        first, last = firsts[t], lasts[t]
        moved, cells = first - firsts[t - 1], last - first + 1
        j, out, part = places[first:last + 1], new[1:cells + 1], other[:cells]
        np.subtract(t, j, out=part)
        np.multiply(share[1 + moved:1 + moved + cells], part, out=out)
        np.multiply(share[moved:moved + cells], j, out=part)
        out += part
        out /= t
        new[cells + 1:cells + 3] = 1.0
        share, new = new, share
    return float(share[1 + n - firsts[-1]])


def exact_tail():
    """Exact P(D >= d) for a batch of result rows; the cells of a pass are bounded."""
    @F.pandas_udf("double")
    def exact(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        known = np.flatnonzero(d.notna().to_numpy())
        values, m, n = (x.to_numpy(np.float64)[known] for x in (d, n1, n2))
        out = np.full(len(d), np.nan)
        beyond = values * np.sqrt(m * n / (m + n)) > _KS_NOTHING
        out[known[beyond]] = 0.0
        values, m, n, known = (x[~beyond] for x in (values, m, n, known))
        wide = 2 * values * m * n / (m + n) > _KS_WIDE
        for k in np.flatnonzero(wide):
            a, b = int(m[k]), int(n[k])
            g = math.gcd(a, b)
            out[known[k]] = lattice_tail(round(values[k] * (a // g) * b), a, b, a // g, b // g)
        values, m, n, known = (x[~wide] for x in (values, m, n, known))
        # Tests of like size go together, so that a band is not padded to another one's width.
        order = np.argsort(values * np.maximum(m, n), kind="stable")
        cells = np.cumsum(values[order] * np.maximum(m, n)[order] + 8)
        for part in np.split(order, np.flatnonzero(np.diff(cells // 4_000_000)) + 1):
            out[known[part]] = lattice_tails(values[part], m[part].astype(np.int64), n[part].astype(np.int64))
        return pd.Series(out)

    return exact
