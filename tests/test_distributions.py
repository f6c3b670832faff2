import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from measureframe.operators import distributions as d


def test_histogram_shares_and_edges(m):
    out = d.histogram(m, "photons", "fov")
    assert out.count() == 100
    sums = out.agg(*[F.sum(F.col(f"`{g} [rel %]`")) for g in "ANR"]).first()
    assert list(sums) == pytest.approx([100.0] * 3)
    values = np.array([r[0] for r in m.select("photons").dropna().collect()])
    counts, edges = np.histogram(values, 100)
    rows = d.histogram_long(m, "photons").orderBy("bin").collect()
    assert [r["count"] for r in rows] == counts.tolist()
    assert [r["bin edge low"] for r in rows] == pytest.approx(edges[:-1].tolist())


def test_histogram_options(m):
    settings = {"photons": (0, 20, 10)}
    partial = d.histogram(m, "photons", (), settings).agg(F.sum("`all [rel %]`")).first()[0]
    assert 0 < partial < 100  # values outside count in the denominator
    stacked = d.histogram(m, "photons", "fov", stacked=True).agg(F.sum("`R [rel %]`")).first()[0]
    assert stacked == pytest.approx(100.0)
    top = d.histogram(m, "photons", cumulative=True).agg(F.max("`all [rel %]`")).first()[0]
    assert top == pytest.approx(100.0)
    density = d.histogram_long(m, "photons", density=True).agg(
        F.sum(F.col("share") * (F.col("bin edge high") - F.col("bin edge low")))).first()[0]
    assert density == pytest.approx(1.0)


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    rows = d.histogram_long(df, "x", bins=2).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [0, 2] and rows[0]["bin edge low"] == 1.5


def test_kde_against_numpy(spark):
    x = np.random.default_rng(0).normal(size=300).round(1)
    df = spark.createDataFrame([("g", float(v)) for v in x] + [("one", 1.0), ("g", float("inf"))], "g string, x double")
    rows = d.kde_long(df, "x", "g").orderBy("i").collect()
    assert {r["g"] for r in rows} == {"g"} and len(rows) == 200  # no spread, no density
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(max(x.min() - 3 * h, x.min()), min(x.max() + 3 * h, x.max()), 200)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert [r["y"] for r in rows] == pytest.approx(want.tolist())
    assert d.kde(df, "x").columns == ["i", "ungrouped_x", "ungrouped_y"]
    assert d.kde(df, "x", "g", ["g"]).columns == ["i", "g_x", "g_y"]


def test_box(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]], "g string, x double")
    row = d.box_stats(df, "x", "g").first()
    assert (row["q1"], row["median"], row["q3"], row["whisker high"], row["outliers"]) == (2.0, 3.0, 4.0, 4.0, 1)
    assert d.box_stats(df, "x").first()["n"] == 5
    assert [r["x"] for r in d.box_outliers(df, "x", "g").collect()] == [100.0]
    assert set(d.violin_stats(df, "x", "g")) == {"box", "density"}


def test_box_sliced(m, sliced):
    far = d.box_stats(m, "nadph_t2", "fov").orderBy("fov").collect()
    m.sparkSession.conf.unset("spark.measureframe.taskRows")
    near = d.box_stats(m, "nadph_t2", "fov").orderBy("fov").collect()
    for a, b in zip(far, near):
        assert list(a)[1:] == pytest.approx(list(b)[1:])


def test_swarm_has_every_point(m):
    assert d.swarm_points(m, "photons", "fov").count() == m.filter("photons is not null").count() > 1000
    assert d.swarm_points(m.limit(50), "nadph_t1", "fov").count() == 50


def test_bootstrap_interval_is_close_to_the_normal_one(m):
    boot = {r["fov"]: r for r in d.line_ci(m, "fov", "photons").collect()}
    norm = {r["fov"]: r for r in d.line_ci(m, "fov", "photons", method="normal").collect()}
    again = {r["fov"]: r for r in d.line_ci(m.repartition(3), "fov", "photons").collect()}
    for g in norm:
        width = norm[g]["high"] - norm[g]["low"]
        assert boot[g]["low"] == pytest.approx(norm[g]["low"], abs=0.1 * width)
        assert boot[g]["high"] == pytest.approx(norm[g]["high"], abs=0.1 * width)
        assert again[g]["low"] == pytest.approx(boot[g]["low"])  # the same weights wherever a row is


def test_pairs_and_panel(m):
    grid = d.pair_matrix(m, ["photons", "nadph_t1"], ["photons", "nadph_t1"], "fov", corner=True)
    assert set(grid) == {("photons", "photons"), ("photons", "nadph_t1"), ("nadph_t1", "nadph_t1")}
    bins = d.scatter_bins(m, "photons", "nadph_t1", "fov")
    assert bins.agg(F.sum("count")).first()[0] == d.scatter_points(m, "photons", "nadph_t1").count()
    with pytest.raises(ValueError):
        d.ratio_panel(m, ["fov"])


def test_poisson_draws_of_frequent_counts_by_their_guide_are_those_of_the_search():
    h, guides = np.arange(1, 601, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D), {}
    for c in (1, 3, 40):
        many = d.poisson_draws(h, np.full(600, c), 1000, guides)
        alone = np.concatenate([d.poisson_draws(h[k:k + 1], np.array([c]), 1000) for k in range(600)])
        assert np.array_equal(many, alone)
    assert sorted(guides) == [1, 3, 40]


def test_poisson_draws_have_the_moments_and_depend_on_hash_and_replicate_alone():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    for c in (1, 3, 40, 10_000):
        w = d.poisson_draws(h, np.full(400, c), 500)
        assert w.mean() == pytest.approx(c, rel=0.02) and w.var() == pytest.approx(c, rel=0.05)
    mixed = d.poisson_draws(h, np.arange(1, 401), 50)
    alone = np.concatenate([d.poisson_draws(h[k:k + 1], np.array([k + 1]), 50) for k in range(400)])
    assert (mixed == alone).all()


def test_bootstrap_interval_against_the_normal_one(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g in ("a", "b") for v in rng.normal(10 if g == "a" else 20, 2, 400).round(1)]
    df = spark.createDataFrame(rows, "g string, y double")
    got = {r["g"]: r for r in d.line_ci(df.repartition(3), "g", "y").collect()}
    want = {r["g"]: r for r in d.line_ci(df, "g", "y", method="normal").collect()}
    for g in "ab":
        assert got[g]["n"] == 400 and got[g]["mean"] == pytest.approx(want[g]["mean"])
        for end in ("low", "high"):
            assert got[g][end] == pytest.approx(want[g][end], abs=0.06)
    for r in d.line_ci(df.repartition(1), "g", "y").collect():
        assert tuple(r)[1:] == pytest.approx(tuple(got[r["g"]])[1:])
