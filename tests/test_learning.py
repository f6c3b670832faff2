import numpy as np
import pytest
from pyspark.sql import functions as F

from measureframe.operators import learning

FEATURES = ["nadph_a2p", "nadph_t2", "photons"]


def test_standardize(m):
    z = [r[0] for r in learning.standardize(m, ["nadph_t2"]).select("nadph_t2__standardized").collect()]
    assert np.mean(z) == pytest.approx(0, abs=1e-9) and np.std(z) == pytest.approx(1)


def test_pca_against_numpy(m):
    comps, explained = learning.pca(m, FEATURES, None, True, True)
    x = m.select(*FEATURES).dropna().toPandas().to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    values = np.linalg.svd(z, compute_uv=False) ** 2
    shares = [r["explained var ratio"] for r in explained.collect()]
    assert shares == pytest.approx((values / values.sum()).tolist()) and sum(shares) == pytest.approx(1)
    pcs = comps.select("PC 1", "PC 2", "PC 3").toPandas()
    cov = np.cov(pcs.to_numpy().T)
    assert cov - np.diag(np.diag(cov)) == pytest.approx(np.zeros((3, 3)), abs=1e-6)
    assert "nadph_t2__standardized" in comps.columns and "fov" in comps.columns
    assert learning.pca(m, FEATURES, 0.3)[1].count() == 1
    assert learning.pca(m, FEATURES, 2)[0].columns[-2:] == ["PC 1", "PC 2"]


def test_kmeans_finds_two_lumps(spark):
    rng = np.random.default_rng(0)
    rows = [("l", float(a), float(b)) for a, b in rng.normal(0, 0.1, (40, 2))]
    rows += [("h", float(a), float(b)) for a, b in rng.normal(5, 0.1, (30, 2))] + [("n", None, 1.0)]
    out = learning.kmeans(spark.createDataFrame(rows, "k string, a double, b double"), ["a", "b"])
    assert {(r["k"], r["Cluster"]) for r in out.collect()} == {("l", "Cluster 1"), ("h", "Cluster 2")}
    assert out.columns == ["k", "Cluster", "a", "b"]


@pytest.mark.parametrize("init", ["k-means++", "random"])
def test_kmeans_does_not_depend_on_partitions_and_copies_count(spark, init):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b)) for c in ((0, 0), (6, 0), (0, 7), (9, 9)) for a, b in rng.normal(c, 0.5, (60, 2))] * 2
    df = spark.createDataFrame(rows, "a double, b double")
    got = [sorted(map(tuple, learning.kmeans(df.repartition(k), ["a", "b"], 4, init=init, n_init=6, tol=0.0, seed=2).collect())) for k in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    by = {}
    for name, a, b in got[0]:
        by.setdefault(name, []).append((a, b))
    assert sorted(len(v) for v in by.values()) == [120] * 4


def test_kmeans_of_fewer_points_than_clusters_and_of_nothing(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 3 + [(2.0, 1.0)], "a double, b double")
    assert sorted(r["Cluster"] for r in learning.kmeans(df, ["a", "b"], 5).collect()) == ["Cluster 1"] * 3 + ["Cluster 2"]
    assert learning.kmeans(df.limit(0), ["a", "b"], 2).count() == 0


def test_forest(m):
    df = m.withColumn("kind", F.when(F.col("nadph_t2") > 4000, "hi").otherwise("lo"))
    scores, accuracy = learning.random_forest(df, FEATURES, "kind", n_trees=10, max_depth=4)
    rows = scores.collect()
    assert rows[0]["Feature"] == "nadph_t2" and sum(r[1] for r in rows) == pytest.approx(1)
    assert accuracy.first()["Accuracy"] > 0.9


def test_labels_round_trip(m):
    coded, model = learning.label_encode(m.select("fov"), "fov")
    labels = model.labelsArray[0]
    assert labels == ["A", "N", "R"]
    back = learning.label_decode(coded, "fov code", labels, "again")
    assert back.filter("fov <> again").count() == 0


@pytest.mark.parametrize("small", ["5", "1000000"])
def test_group_split_is_by_group(m, spark, small):
    spark.conf.set("spark.measureframe.taskRows", small)
    try:
        out = learning.group_split(m, ["fov", "cell", "treatment"], 0.7, series="treatment")
        groups = out.select("fov", "cell", "training").distinct().collect()
    finally:
        spark.conf.unset("spark.measureframe.taskRows")
    assert len(groups) == 30 and sum(r["training"] for r in groups) == 21
    assert out.count() == m.count()
    rows = learning.group_split(m, (), 0.7)
    share = rows.filter("training").count() / m.count()
    assert 0.65 < share < 0.75


def test_minmax_uses_training_rows(spark):
    df = spark.createDataFrame([(0.0, True), (10.0, True), (20.0, False), (None, False)], "x double, t boolean")
    assert [r[0] for r in learning.minmax_impute(df, ["x"], F.col("t")).collect()] == [0.0, 1.0, 2.0, 0.0]
