import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from measureframe.operators import statistics as s
from measureframe.plans import ranking

FEATURES = ["nadph_a2p", "photons", "fad_a1p"]


def matrix(df):
    return df.toPandas().set_index("Feature").loc[FEATURES, FEATURES].to_numpy()


def tau_b(x, y):
    num = nx = ny = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        num, nx, ny = num + a * b, nx + a * a, ny + b * b
    return num / math.sqrt(nx * ny)


@pytest.mark.parametrize("small", ["10", "1000000"])
def test_correlations_pairwise_complete(m, spark, small, monkeypatch):
    monkeypatch.setattr(ranking, "TASK_VALUES", 50 * int(small))
    spark.conf.set("spark.measureframe.taskRows", small)
    try:
        pdf = m.toPandas()[FEATURES]
        assert matrix(s.correlation_matrix(m, FEATURES)) == pytest.approx(pdf.corr().to_numpy())
        want = np.eye(3)
        for i, j in itertools.permutations(range(3), 2):
            both = pdf[[FEATURES[i], FEATURES[j]]].dropna().rank()
            want[i, j] = both.corr().iloc[0, 1]
        assert matrix(s.correlation_matrix(m, FEATURES, "spearman")) == pytest.approx(want)
    finally:
        spark.conf.unset("spark.measureframe.taskRows")


@pytest.mark.parametrize("small", ["10", "1000000"])
def test_kendall_against_all_pairs(spark, small):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, 150).astype(float)
    y = x + rng.integers(0, 30, 150)
    z = rng.normal(size=150)
    pdf = pd.DataFrame({"x": x, "y": y, "z": z})
    df = spark.createDataFrame(pdf)
    spark.conf.set("spark.measureframe.taskRows", small)
    try:
        got = s.correlation_matrix(df, ["x", "y", "z"], "kendall").toPandas().set_index("Feature")
    finally:
        spark.conf.unset("spark.measureframe.taskRows")
    for a, b in itertools.combinations("xyz", 2):
        assert got.loc[a, b] == pytest.approx(tau_b(pdf[a], pdf[b]))
    with pytest.raises(ValueError):
        s.correlation_matrix(df, ["x"], "other")


@pytest.mark.parametrize("small", ["20", "1000000"])
def test_kendall_and_spearman_with_missing_values_and_hot_ties(spark, small, monkeypatch):
    """A third of each column is one value, other places are missing; groups are smaller than the ties."""
    monkeypatch.setattr(ranking, "TASK_VALUES", 30)
    rng = np.random.default_rng(8)
    cols = {}
    for k, name in enumerate("xyzw"):
        v = rng.integers(0, 50, 240).astype(float) + (cols["x"] if k == 1 else 0)
        v[rng.random(240) < 0.33] = 17.0
        if k:
            v[rng.random(240) < 0.1 * k] = np.nan
        cols[name] = v
    pdf = pd.DataFrame(cols)
    spark.conf.set("spark.measureframe.taskRows", small)
    try:
        got = {k: s.correlation_matrix(spark.createDataFrame(pdf), list("xyzw"), k).toPandas().set_index("Feature") for k in ("kendall", "spearman")}
    finally:
        spark.conf.unset("spark.measureframe.taskRows")
    for a, b in itertools.permutations("xyzw", 2):
        both = pdf[[a, b]].dropna()
        assert got["kendall"].loc[a, b] == pytest.approx(tau_b(both[a].to_numpy(), both[b].to_numpy()))
        assert got["spearman"].loc[a, b] == pytest.approx(both.rank().corr().iloc[0, 1])


def test_kendall_sends_a_row_once_a_feature_and_no_row_a_bit(spark):
    """Rows of distinct values, more than a task may sort: what the shuffles write stays below the bytes of the values, once a feature."""
    rng = np.random.default_rng(11)
    k = 40_000
    x = rng.normal(size=k)
    pdf = pd.DataFrame({"x": x, "y": x + rng.normal(size=k), "z": rng.integers(0, 12, k).astype(float)})
    df = spark.createDataFrame(pdf)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def kept():
        found = disk.getAllFiles()
        return {f.getPath(): f.length() for f in (found.apply(i) for i in range(found.size()))}

    before = kept()
    spark.conf.set("spark.measureframe.taskRows", "10000")
    try:
        got = s.correlation_matrix(df, ["x", "y", "z"], "kendall").toPandas().set_index("Feature")
    finally:
        spark.conf.unset("spark.measureframe.taskRows")
    written = sum(size for path, size in kept().items() if path not in before)
    once = np.ones(k, np.int64)
    spread = {c: k * (k - 1) / 2 - sum(t * (t - 1) / 2 for t in pdf[c].value_counts()) for c in "xyz"}
    for a, b in itertools.combinations("xyz", 2):
        want = s.concordance(pdf[a].to_numpy(), pdf[b].to_numpy(), once) / math.sqrt(spread[a] * spread[b])
        assert got.loc[a, b] == got.loc[b, a] == pytest.approx(want, rel=1e-12)
    assert written < 3 * k * 3 * 8


def test_kendall_slices_of_one_value_and_missing_values(spark):
    """Values with a slice's share beside rare ones and infinities; partners that are missing, wholly or where a value is frequent."""
    rng = np.random.default_rng(12)
    k = 300
    hot = np.where(rng.random(k) < 0.7, rng.choice([1.0, 2.0, 3.0], k), rng.normal(2, 1, k))
    few = rng.choice([-0.0, 0.0, 5.0, 7.0], k)
    cols = {"hot": hot, "few": few + (hot > 2) * 5, "fine": hot + rng.normal(size=k), "one": np.full(k, 4.0), "none": np.full(k, np.nan)}
    cols["fine"][rng.random(k) < 0.1] = np.inf
    cols["few"][(hot == 1.0) | (rng.random(k) < 0.1)] = np.nan
    pdf = pd.DataFrame(cols)
    spark.conf.set("spark.measureframe.taskRows", "60")
    try:
        got = s.correlation_matrix(spark.createDataFrame(pdf), list(cols), "kendall").toPandas().set_index("Feature")
    finally:
        spark.conf.unset("spark.measureframe.taskRows")
    for a, b in itertools.permutations(cols, 2):
        both = pdf[[a, b]].replace(np.inf, 1e9).dropna()
        if "one" in (a, b) or "none" in (a, b):
            assert pd.isna(got.loc[a, b])
        else:
            assert got.loc[a, b] == pytest.approx(tau_b(both[a].to_numpy(), both[b].to_numpy()), rel=1e-12)


def test_concordance_against_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(50):
        k = rng.integers(1, 40)
        x, y, c = rng.integers(0, 9, k), rng.integers(0, 12, k), rng.integers(1, 4, k)
        want = sum(int(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) * c[i] * c[j]) for i in range(k) for j in range(i))
        assert s.concordance(x, y, c) == want


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert s.correlation_matrix(df, ["x", "y"]).first()["y"] is None


def ks_d(a, b):
    grid = np.sort(np.concatenate([a, b]))
    f = np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b)
    return np.abs(f).max()


@pytest.mark.parametrize("small", ["10", "1000000"])
def test_ks_distance(m, spark, small):
    spark.conf.set("spark.measureframe.taskRows", small)
    try:
        out = s.ks_test(m, "photons", "treatment", ["fov", "treatment"]).toPandas()
    finally:
        spark.conf.unset("spark.measureframe.taskRows")
    pdf = m.toPandas().dropna(subset=["photons"])
    assert len(out) == 3 * 10
    for _, r in out.iterrows():
        part = pdf[pdf.fov == r["fov"]]
        a = part[part.treatment == r["treatment 1"]].photons.to_numpy()
        b = part[part.treatment == r["treatment 2"]].photons.to_numpy()
        assert r["statistic"] == pytest.approx(ks_d(a, b))
        assert (r["n (treatment 1)"], r["n (treatment 2)"]) == (len(a), len(b))
        assert 0 <= r["p-values"] <= 1


def test_ks_extremes_and_labels(spark):
    rows = [("a", float(i)) for i in range(5)] + [("b", float(i)) for i in range(5)] + [("c", 10.0 + i) for i in range(5)]
    out = {r["g 1 & 2"]: r for r in s.ks_test(spark.createDataFrame(rows, "g string, x double"), "x", "g", pvalue="exact").collect()}
    assert out["a-b"]["statistic"] == 0.0 and out["a-b"]["p-values"] == 1.0
    assert out["a-c"]["statistic"] == 1.0 and out["a-c"]["Grouping"] == "none"
    assert out["a-c"]["p-values"] == pytest.approx(2 / math.comb(10, 5))
    assert out["a-c"]["dissimilar (<0.05)"] == "Yes" and out["a-b"]["dissimilar (<0.05)"] == "No"
    single = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, x double")
    assert s.ks_test(single, "x", "g", pvalue="exact").first()["p-values"] == 1.0
    assert s.ks_test(single.filter("g = 'a'"), "x", "g").count() == 0
    with pytest.raises(ValueError):
        s.ks_test(single, "x", "g", pvalue="auto")


def test_exact_p_by_enumeration(spark):
    rows = [("a", v) for v in (1.0, 3.0, 5.0, 7.0)] + [("b", v) for v in (2.0, 8.0, 9.0)]
    row = s.ks_test(spark.createDataFrame(rows, "g string, x double"), "x", "g", pvalue="exact").first()
    hits = total = 0
    for chosen in itertools.combinations(range(7), 4):
        a = np.array(chosen, float)
        b = np.array([i for i in range(7) if i not in chosen], float)
        total += 1
        hits += ks_d(a, b) >= row["statistic"] - 1e-9
    assert row["p-values"] == pytest.approx(hits / total)


@pytest.mark.parametrize("sliced_rows", ["10", "1000000"])
def test_many_labels_in_slices_and_pieces(spark, monkeypatch, sliced_rows):
    """30 labels, some of them missing in a group, against direct distances."""
    monkeypatch.setattr(s, "_KS_VALUES", 7)
    spark.conf.set("spark.measureframe.taskRows", sliced_rows)
    rng = np.random.default_rng(3)
    rows = [(str(int(g)), int(k), float(x)) for g, k, x in zip(rng.integers(0, 2, 900), rng.integers(0, 30, 900), rng.integers(0, 60, 900)) if g or k > 3]
    try:
        out = s.ks_test(spark.createDataFrame(rows, "g string, k int, x double"), "x", "k", "g").collect()
        some = s.ks_test(spark.createDataFrame(rows, "g string, k int, x double"), "x", "k", "g", values=[9, 5, 2]).collect()
    finally:
        spark.conf.unset("spark.measureframe.taskRows")
    values = {}
    for g, k, x in rows:
        values.setdefault((g, k), []).append(x)
    pairs = {(g, a, b) for g, a in values for h, b in values if g == h and a < b}
    assert len(out) == len(pairs)
    for r in out:
        a, b = int(r["k 1"]), int(r["k 2"])
        assert (r["g"], a, b) in pairs
        assert r["statistic"] == pytest.approx(ks_d(np.array(values[r["g"], a]), np.array(values[r["g"], b])))
    assert sorted((r["g"], r["k 1"], r["k 2"]) for r in some) == [("0", "9", "5"), ("1", "5", "2"), ("1", "9", "2"), ("1", "9", "5")]




def whole_diagonals(d, m, n):
    """The share of paths that leave the band, over all cells of every diagonal."""
    g = math.gcd(m, n)
    steps = round(d * (m // g) * n)
    share = {(0, 0): 0.0}
    for t in range(1, m + n + 1):
        for j in range(max(0, t - m), min(n, t) + 1):
            i = t - j
            left, below = share.get((i - 1, j), 0.0), share.get((i, j - 1), 0.0)
            share[i, j] = 1.0 if abs(i * (n // g) - j * (m // g)) >= steps else (left * i + below * j) / t
    return share[m, n]


def test_exact_tails_of_many_tests_at_once():
    rng = np.random.default_rng(5)
    m, n = rng.integers(1, 30, 120), rng.integers(1, 30, 120)
    lcm = m * n // np.gcd(m, n)
    d = np.array([rng.integers(0, k + 1) for k in lcm]) / lcm
    got = s.lattice_tails(d, m, n)
    want = [whole_diagonals(*map(float, (a,)), int(b), int(c)) if a > 0 else 1.0 for a, b, c in zip(d, m, n)]
    assert got == pytest.approx(want, rel=1e-12, abs=1e-300)


def test_exact_tail_of_twenty_thousand_against_the_series():
    import time

    start = time.monotonic()
    p = s.lattice_tails(np.array([0.0136]), np.array([20_000]), np.array([20_000]))[0]
    assert time.monotonic() - start < 20
    lam = 0.0136 * math.sqrt(10_000)
    assert p == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 50)), rel=0.02)


def test_one_wide_exact_tail_is_that_of_the_batch():
    rng = np.random.default_rng(6)
    for _ in range(60):
        m, n = (int(k) for k in rng.integers(1, 60, 2))
        g = math.gcd(m, n)
        steps = int(rng.integers(1, m // g * n + 1))
        want = s.lattice_tails(np.array([steps / (m // g * n)]), np.array([m]), np.array([n]))[0]
        assert s.lattice_tail(steps, m, n, m // g, n // g) == want


def test_exact_tests_are_spread_over_tasks(spark):
    """A test of the largest size is one task's; 300 of them were one task's, too."""
    rows = [(g, l, float(i % (7 + k))) for g in range(12) for k, l in enumerate("abc") for i in range(30)]
    out = s.ks_test(spark.createDataFrame(rows, "g int, l string, x double"), "x", "l", "g", pvalue="exact")
    parts = out.withColumn("_part", F.spark_partition_id()).select("_part").distinct().count()
    assert out.count() == 36 and parts > 8
    # Beyond every double the tail is 0, without the lattice.
    far = [(l, float(i + 10 * k)) for k, l in enumerate("ab") for i in range(2000)] + [("c", float(i + 10**6)) for i in range(2000)]
    got = {r["l 1 & 2"]: r["p-values"] for r in s.ks_test(spark.createDataFrame(far, "l string, x double"), "x", "l", pvalue="exact").collect()}
    assert got["a-c"] == got["b-c"] == 0.0 and got["a-b"] == pytest.approx(1.0, abs=1e-6)


def test_values_that_many_rows_share_are_one_entry(spark):
    """Ranks are counted on from distinct values, so no task holds the rows of one value."""
    from measureframe.plans.ranking import ranked

    df = spark.range(480).selectExpr("double(id % 3) AS x", "if(id % 4 = 0, null, double(id % 5)) AS y")
    found = ranked(df, ["x", "y"])
    rows = found.rows.collect()
    assert found._held[1].count() == 3 * 2 + 5 and len(rows) == 3 * 6 and sum(r["_count"] for r in rows) == 480
    found.release()
    for kind in ("spearman", "kendall"):
        got = s.correlation_matrix(df, ["x", "y"], kind).toPandas().set_index("Feature")
        assert got.loc["x", "y"] == pytest.approx(df.toPandas().corr(kind).loc["x", "y"] if kind == "spearman" else tau_b(*df.dropna().toPandas().to_numpy().T), abs=1e-9)
