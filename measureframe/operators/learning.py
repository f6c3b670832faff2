"""Scaling, principal components, clusters, random forest, group splits."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from measureframe.plans.lineage import settled
from measureframe.plans.ordering import cut_points, join_on, running_totals, slice_count, task_rows
from measureframe.roles import (
    SEP, as_category, as_list, categories, drop_missing, join_name, q, with_columns,
)


# Workers get these helpers by value, so they need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def standardize(df: DataFrame, features: Sequence[str], sep: str = SEP) -> DataFrame:
    """Append ``<feature>`` + ``standardized``: z-scores with the population deviation."""
    stats = df.agg(F.struct(
        *[F.avg(q(f)).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(q(f)).alias(f"s{i}") for i, f in enumerate(features)],
    )).scalar()
    return df.select("*", *[
        # A constant column is only centred.
        ((q(f) - stats[f"m{i}"]) / F.coalesce(F.nullif(stats[f"s{i}"], F.lit(0.0)), F.lit(1.0)))
        .alias(join_name(f, "standardized", sep=sep))
        for i, f in enumerate(features)
    ])


def _z_vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with all features, and their z-scores as vector ``_z``."""
    complete = drop_missing(df, features)
    scaled = standardize(complete, features, sep="\x01")
    names = [join_name(f, "standardized", sep="\x01") for f in features]
    plain = scaled.select(
        *[q(c) for c in df.columns], *[q(n).alias(f"_z{i}") for i, n in enumerate(names)]
    )
    built = VectorAssembler(inputCols=[f"_z{i}" for i in range(len(names))], outputCol="_z").transform(plain)
    return built.select(*[q(c) for c in df.columns], "_z")


def pca(
    df: DataFrame,
    features: Sequence[str],
    n_components: float | int | None = 0.999,
    keep_original: bool = False,
    keep_standardized: bool = False,
    sep: str = SEP,
) -> tuple[DataFrame, DataFrame]:
    """(components with the categories, explained variance per component).

    ``n_components``: None for all, a share for the fewest components that reach it,
    or a number.  The largest loading of every component is positive.
    """
    feats = list(features)
    rows = _z_vectors(df, feats)
    model = PCA(k=len(feats), inputCol="_z", outputCol="_pc").fit(rows)
    shares = model.explainedVariance.toArray()
    if n_components is None:
        k = len(feats)
    elif isinstance(n_components, float) and 0 < n_components < 1:
        k = min(len(feats), int(np.searchsorted(np.cumsum(shares), n_components - 1e-12)) + 1)
    else:
        k = int(n_components)
    loadings = model.pc.toArray()
    top = np.abs(loadings).argmax(axis=0)
    signs = np.where(loadings[top, range(loadings.shape[1])] < 0, -1.0, 1.0)
    scored = model.transform(rows).withColumn("_pc", vector_to_array("_pc")).withColumn("_za", vector_to_array("_z"))
    out = [q(c) for c in categories(df)]
    if keep_original:
        out += [q(f) for f in feats]
    if keep_standardized:
        out += [F.get("_za", F.lit(i)).alias(join_name(f, "standardized", sep=sep)) for i, f in enumerate(feats)]
    out += [(F.get("_pc", F.lit(i)) * float(signs[i])).alias(f"PC {i + 1}") for i in range(k)]
    explained = df.sparkSession.createDataFrame(
        [(f"PC {i + 1}", float(shares[i])) for i in range(k)], "PC string, `explained var ratio` double"
    )
    return scored.select(*out), explained


def _sums(width: int, centres: list[np.ndarray]):
    """Per start and cluster: counts, sums of the points and of their squared distances, over a task's rows."""
    def run(batches):
        total = [np.zeros((len(c), width + 2)) for c in centres]
        for batch in batches:
            x, n = _points(batch, width)
            for s, c in enumerate(centres):
                apart = _squared(x, c)
                label = apart.argmin(axis=1)
                values = np.column_stack([n, x * n[:, None], apart[np.arange(len(x)), label] * n])
                for k in range(values.shape[1]):
                    total[s][:, k] += np.bincount(label, values[:, k], len(c))
        flat = np.concatenate([t.ravel() for t in total])
        yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64()))], names=["sums"])

    return run


def _points(batch, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column(0).flatten(), np.float64).reshape(-1, width), batch.column(1).to_numpy().astype(np.float64)


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all points from all centres."""
    return sum((x[:, i:i + 1] - centres[None, :, i]) ** 2 for i in range(x.shape[1]))


def _drawn(width: int, centres: list[np.ndarray], squares: bool, seed: int):
    """Per start, a task's point with the largest key; the largest of all is drawn in proportion to count x squared distance.

    Without ``squares`` all points that are no centre yet are drawn in proportion to their counts.  The key is log(u) / weight with u from a hash of the point, so a rerun, or other partitions, draw the same.
    """
    def run(batches):
        best: list[tuple[float, list[float]]] = [(-np.inf, [])] * len(centres)
        for batch in batches:
            x, n = _points(batch, width)
            h = batch.column(2).to_numpy().view(np.uint64)
            for s, c in enumerate(centres):
                far = _squared(x, c).min(axis=1) if len(c) else np.ones(len(x))
                weight = n * (far if squares else far > 0)
                mixed = h ^ np.uint64((seed * 1_000_003 + s * 8191 + len(c) * 131 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                    mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
                u = ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
                key = np.where(weight > 0, np.log(u) / np.where(weight > 0, weight, 1.0), -np.inf)
                if len(key) and key.max() > best[s][0]:
                    best[s] = float(key.max()), x[int(key.argmax())].tolist()
        yield pa.RecordBatch.from_arrays([
            pa.array(range(len(best)), pa.int32()), pa.array([k for k, _ in best]), pa.array([p for _, p in best], pa.list_(pa.float64()))], names=["start", "key", "point"])

    return run


def kmeans(
    df: DataFrame,
    features: Sequence[str],
    n_clusters: int = 2,
    init: str = "k-means++",
    n_init: int = 4,
    max_iter: int = 300,
    tol: float = 1e-4,
    seed: int = 0,
    name: str = "Cluster",
) -> DataFrame:
    """Label ``Cluster 1``... on z-scores: the cheapest of ``n_init`` starts.

    Distinct points with their counts are kept once.  Every pass serves all starts: one for each centre that is
    drawn (``init``: ``k-means++``, in proportion to the squared distance from the centres so far, or ``random``), then
    one for each iteration, in which a task hands over the sums of its points per start and cluster.  ``tol`` bounds
    the squared shift of the centres, on features of variance 1; 0 goes on until no centre moves.
    Clusters are numbered by their sorted centres; a cluster that runs empty keeps its centre.
    """
    if init not in ("k-means++", "random"):
        raise ValueError("init must be 'k-means++' or 'random'")
    feats, width = list(features), len(features)
    complete = drop_missing(df, feats)
    stats = complete.agg(*[F.avg(q(f)) for f in feats], *[F.stddev_pop(q(f)) for f in feats]).first()
    z = [(q(f).cast("double") - F.lit(stats[i])) / F.lit(stats[width + i] or 1.0) for i, f in enumerate(feats)]
    points = complete.select(F.array(*z).alias("_z")) if stats[0] is not None else complete.select(F.array(*[F.lit(0.0)] * width).alias("_z"))
    rows = settled(points.groupBy("_z").agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", F.xxhash64("_z")))
    try:
        starts = [np.zeros((0, width)) for _ in range(n_init)]
        for _ in range(n_clusters):
            # One row for each task and start.
            best: dict[int, tuple] = {}
            for r in rows.mapInArrow(_drawn(width, starts, init == "k-means++", seed), "start int, key double, point array<double>").collect():
                if r.point and (r.start not in best or (r.key, r.point) > best[r.start]):
                    best[r.start] = r.key, r.point
            # Fewer distinct points than clusters: there is nothing more to draw.
            starts = [np.vstack([c, best[s][1]]) if s in best else c for s, c in enumerate(starts)]
        costs, moving = [np.inf] * n_init, [s for s in range(n_init) if len(starts[s])]
        for _ in range(max_iter + 1):
            if not moving:
                break
            flat = np.sum([r.sums for r in rows.mapInArrow(_sums(width, [starts[s] for s in moving]), "sums array<double>").collect()], axis=0)
            still = []
            for s in moving:
                part, flat = flat[:len(starts[s]) * (width + 2)].reshape(-1, width + 2), flat[len(starts[s]) * (width + 2):]
                costs[s] = part[:, -1].sum()
                new = np.where(part[:, :1] > 0, part[:, 1:-1] / np.maximum(part[:, :1], 1), starts[s])
                shift = ((new - starts[s]) ** 2).sum()
                if shift > tol:
                    starts[s] = new
                    still.append(s)
            moving = still
    finally:
        rows.unpersist()
    best_start = min(range(n_init), key=lambda s: costs[s])
    centres = sorted(map(tuple, starts[best_start].tolist()))
    label = F.lit(None).cast("string")
    if centres:
        apart = F.array(*[sum(((x - F.lit(c[i])) * (x - F.lit(c[i])) for i, x in enumerate(z)), F.lit(0.0)) for c in centres])
        label = F.concat(F.lit("Cluster "), F.array_position(apart, F.array_min(apart)).cast("string"))
    cats = [c for c in categories(df) if c != name]
    return complete.select(*[q(c) for c in cats], as_category(label, name), *[q(f) for f in feats])


def label_encode(df: DataFrame, columns: str | Sequence[str], suffix: str = " code") -> tuple[DataFrame, object]:
    """Integer codes in sorted label order, and the fitted encoder."""
    cols = as_list(columns)
    model = StringIndexer(
        inputCols=cols, outputCols=[c + suffix for c in cols],
        stringOrderType="alphabetAsc", handleInvalid="keep",
    ).fit(df)
    out = model.transform(df)
    return out.withColumns({c + suffix: F.col(f"`{c}{suffix}`").cast("int") for c in cols}), model


def label_decode(df: DataFrame, code: str, labels: Sequence[str], name: str) -> DataFrame:
    data = with_columns(df, {code: q(code).cast("double")})
    return IndexToString(inputCol=code, outputCol=name, labels=list(labels)).transform(data)


def row_hash(df: DataFrame, seed: int, columns: Sequence[str] | None = None) -> Column:
    """Hash of a row's contents: the same on every run, wherever the row is."""
    return F.xxhash64(F.lit(seed), *[q(c) for c in (columns or df.columns)])


def group_split(
    df: DataFrame,
    grouping: str | Sequence[str] = (),
    train_share: float = 0.7,
    seed: int = 0,
    series: str | None = None,
    name: str = "training",
) -> DataFrame:
    """Append a boolean: whether the row's *group* is in the training share.

    The groups are those of ``grouping`` without the series category; exactly
    round(share x groups) of them train.  Without a grouping, rows are split by a
    hash of their contents (equal rows stay together).
    """
    keys = [k for k in as_list(grouping) if k != series]
    if not keys:
        share = F.pmod(row_hash(df, seed), F.lit(1 << 40)) / F.lit(float(1 << 40))
        return df.withColumn(name, share < F.lit(train_share))
    data = drop_missing(df, keys)
    groups = data.select(*[q(k) for k in keys]).distinct()
    groups = groups.withColumn("_h", row_hash(groups, seed, keys))
    hashes = groups.groupBy("_h").agg(F.count(F.lit(1)).alias("_c"))
    # Only the distinct groups are ranked, in slices when there are many.
    n = groups.count()
    cuts = cut_points(groups, ["_h"], slice_count(df, n))["_h"] if n > task_rows(df) else None
    run = running_totals(hashes, [], "_h", ["_c"], cuts)
    chosen = run.select("_h", (F.col("_c_upto") <= F.round(F.col("_c_total") * train_share)).alias(name))
    marked = groups.join(chosen, "_h").drop("_h")
    return join_on(data, marked, keys)


def minmax_bounds(df: DataFrame, features: Sequence[str]) -> tuple[list[float], list[float]]:
    row = df.agg(*[F.min(q(f)).cast("double") for f in features], *[F.max(q(f)).cast("double") for f in features]).first()
    k = len(features)
    return list(row[:k]), list(row[k:])


def minmax_impute(
    df: DataFrame, features: Sequence[str], training: Column | None = None, fill: float = 0.0
) -> DataFrame:
    """Features scaled by the minimum and range of the training rows; missing becomes 0."""
    use = training if training is not None else F.lit(True)
    ends = df.agg(F.struct(
        *[F.min(F.when(use, q(f))).cast("double").alias(f"lo{i}") for i, f in enumerate(features)],
        *[F.max(F.when(use, q(f))).cast("double").alias(f"hi{i}") for i, f in enumerate(features)],
    )).scalar()

    def scaled(i: int, f: str) -> Column:
        width = ends[f"hi{i}"] - ends[f"lo{i}"]
        unit = F.when(width == 0, F.lit(1.0)).otherwise(width)
        return F.coalesce((q(f) - ends[f"lo{i}"]) / unit, F.lit(fill))

    return with_columns(df, {f: scaled(i, f) for i, f in enumerate(features)})


def random_forest(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    n_trees: int = 100,
    test_share: float = 0.3,
    max_depth: int = 10,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(importances in descending order, accuracy on the held-out rows)."""
    feats = [f for f in features if f != label]
    data = drop_missing(df, [*feats, label]).select(q(label), *[q(f) for f in feats])
    data = group_split(data, (), 1 - test_share, seed, name="_train")
    plain = data.select(
        q(label).cast("string").alias("_label"), "_train",
        *[q(f).cast("double").alias(f"_x{i}") for i, f in enumerate(feats)],
    )
    codes = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc").fit(plain)
    ready = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(feats))], outputCol="_x").transform(
        codes.transform(plain)
    ).select("_x", "_y", "_train")
    train = settled(ready.filter("_train").select("_x", "_y"))
    try:
        forest = RandomForestClassifier(
            featuresCol="_x", labelCol="_y", numTrees=n_trees, maxDepth=max_depth, seed=seed
        ).fit(train)
    finally:
        train.unpersist()
    accuracy = MulticlassClassificationEvaluator(labelCol="_y", metricName="accuracy").evaluate(
        forest.transform(ready.filter("not _train"))
    )
    session = df.sparkSession
    scores = forest.featureImportances.toArray()
    importances = session.createDataFrame(
        [(f, float(s)) for f, s in zip(feats, scores)], "Feature string, `Importance Score` double"
    ).orderBy(F.desc("Importance Score"), "Feature")
    return importances, session.createDataFrame([(label, float(accuracy))], "Label string, Accuracy double")
