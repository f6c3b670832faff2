import numpy as np
import pytest
from pyspark.sql import functions as F

from measureframe.operators import networks as n
from measureframe.sources.sink import glob_models

FEATURES = ["nadph_a2p", "photons", "nadph_t2"]


def test_shapes():
    assert n.ae_spec("AE Dimensionality Reduction 2-10", 4).widths == (4, 10, 1, 10, 4)
    assert n.ae_spec("AE Simulator 1-6", 2) == n.Shape((2, 6, 2), 1)
    assert n.parameter_grid([1, 2], [0.1], [0.0]) == [(1, 0.1, 0.0), (2, 0.1, 0.0)]


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    shape = n.ae_spec("AE Dimensionality Reduction 2-5", 3)
    w, x = n.initial_weights(shape, 1), rng.uniform(size=(7, 3))
    _, grad = n.loss_and_gradient(shape, w, x)
    for i in range(0, shape.size, 5):
        up, down = w.copy(), w.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        diff = (n.loss_and_gradient(shape, up, x)[0] - n.loss_and_gradient(shape, down, x)[0]) / 2e-6
        assert grad[i] == pytest.approx(diff, abs=1e-6)


@pytest.fixture(scope="module")
def fitted(spark, m):
    return n.ae_fit(
        m, FEATURES, ["fov", "cell"], "treatment", "AE Simulator 1-3", epochs=6,
        learning_rates=[1e-2, 1e-3], checkpoint_interval=4, rescale=True,
    )


def test_loss_falls_and_models_are_kept(fitted):
    rows = fitted["loss"].collect()
    assert len(rows) == 12
    best = [r for r in rows if r["Learning Rate"] == "0.01"]
    assert best[-1]["Training Loss"] < best[0]["Training Loss"] and best[-1]["Validation Loss"] > 0
    assert [r["Model File"] == "---" for r in best] == [True, True, True, False, True, False]
    assert fitted["models"].count() == 4


def test_decoded_and_encoded(fitted, m):
    decoded = fitted["decoded"]
    assert decoded.count() == 2 * m.count()
    assert {r[0] for r in decoded.select("Autoencoder").distinct().collect()} == {"training", "validation"}
    assert fitted["encoded"].columns[-3:] == ["AE Encoded 0", "AE Encoded 1", "AE Encoded 2"]
    assert decoded.columns[-3:] == [f"AE Recon {f}" for f in FEATURES]


def test_saved_models_apply_alike(fitted, m, spark, tmp_path):
    n.save_models(fitted["models"], str(tmp_path / "models"))
    loaded = glob_models(spark, str(tmp_path / "mod*"))
    recon, coded = n.ae_apply(m, loaded)
    assert recon.count() == 4 * m.count() and coded.columns[-1] == "Feature 3"
    again, _ = n.ae_apply(m, fitted["models"])
    total = [d.agg(F.sum("Recon Feature 1")).first()[0] for d in (recon, again)]
    assert total[0] == pytest.approx(total[1])


def test_augment(spark, fitted, m):
    df = spark.createDataFrame(
        [("f", "1", 30.0, 10.0, 3.0), ("f", "2", 0.0, 0.0, 4.0)],
        "FOV string, Cell string, `N a1` double, `N a2` double, `N t1` double")
    out = n.ae_augment(df, ["N a1", "N a2", "N t1"], ["FOV", "Cell"], 3)
    assert out.columns == ["FOV", "Cell", "N a1", "N a1%", "N a2", "N a2%", "N t1"]
    rows = {r["Cell"]: r["N a1%"] for r in out.collect()}
    assert rows == {"1": 75.0, "2": None, "3": 75.0, "4": None, "5": 75.0, "6": None} or len(rows) < 6
    text = df.withColumn("Cell", F.concat(F.lit("c"), "Cell"))
    names = {r["Cell"] for r in n.ae_augment(text, ["N a1"], ["FOV", "Cell"], 2).collect()}
    assert names == {"c1.0", "c2.0", "c1.1", "c2.1"}
    modelled = n.ae_augment(m, FEATURES, ["fov", "cell"], 2, fitted["models"].filter("epoch = 6"))
    assert modelled.count() == 2 * 2 * m.count()


def test_noise_of_equal_rows_is_dealt_out(spark):
    df = spark.range(10_500).select((F.col("id") % 2).cast("string").alias("g"), F.lit(5.0).alias("x"))
    out = n.ae_augment(df, ["x"], ["g"], 2, add_noise=True, snr_db=20.0)
    held = out.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in held) == 21_000 and max(r["count"] for r in held) < 15_000
    assert out.select("x").distinct().count() == 21_000


def test_noise_level(spark):
    df = spark.range(20000).select(F.lit("a").alias("g"), (F.lit(10.0) + F.col("id") * 0).alias("x"))
    out = n.ae_augment(df, ["x"], ["g"], 1, add_noise=True, snr_db=20.0)
    row = out.agg(F.avg("x"), F.stddev("x")).first()
    assert row[0] == pytest.approx(10, abs=0.05) and row[1] == pytest.approx(1.0, rel=0.05)


def test_networks_copy_amplitude_names():
    assert n.amplitude_columns(["FAD a1", "FAD a2", "FAD t1", "NAD a1%"]) == {"FAD": ["FAD a1", "FAD a2"], "NAD": []}


def sequential(rows, seed, width, network, epochs, grid, blocks):
    """Mini-batch RMSprop in one process, written out plainly; rows are (hash, trains, values)."""
    shape = n.ae_spec(network, width)
    rows, out = sorted(rows), {}
    held = np.array([r[2] for r in rows if not r[1]])
    parts = [np.array([r[2] for r in rows if r[1] and r[0] % blocks == k]).reshape(-1, width) for k in range(blocks)]
    for c, (batch, rate, decay) in enumerate(grid):
        w, v = n.initial_weights(shape, seed), np.zeros(shape.size)
        for epoch in range(1, epochs + 1):
            losses = []
            for k in np.random.default_rng([seed, epoch]).permutation(blocks):
                x = parts[k][np.random.default_rng([seed, epoch, int(k)]).permutation(len(parts[k]))]
                for start in range(0, len(x), batch):
                    loss, g = n.loss_and_gradient(shape, w, x[start:start + batch])
                    g = g + decay * w
                    v = 0.99 * v + 0.01 * g * g
                    w = w - rate * g / (np.sqrt(v) + 1e-8)
                    losses.append(loss)
            out[epoch, c] = (np.mean(losses), np.mean((n.forward(shape, w, held)[-1] - held) ** 2))
    return out


@pytest.mark.parametrize("limit, tasks, parts, arrow", [(10**6, None, 3, 10_000), (10**6, 4, 5, 100), (2000, 1, 3, 10_000), (2000, 3, 7, 7)])
def test_training_equals_one_sequential_run(spark, m, limit, tasks, parts, arrow):
    """The same losses to 1e-9 however rows are dealt to blocks, tasks, partitions and Arrow batches."""
    from measureframe.operators.learning import group_split, minmax_impute

    feats, seed = ["nadph_a2p", "photons"], 3
    split = group_split(m, ["fov", "cell"], 0.7, seed, "treatment", name="_train")
    scaled = minmax_impute(split, feats, F.col("_train")).select(F.array(*feats).alias("_x"), "_train")
    rows = [(r[0], r[1], list(r[2])) for r in scaled.select(F.xxhash64(F.lit(seed), "_x"), "_train", "_x").collect()]
    grid = n.parameter_grid([128, 50], [1e-2], [1e-8])
    want = sequential(rows, seed, 2, "AE Simulator 1-3", 3, grid, -(-len(rows) // limit))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(arrow))
    spark.conf.set("spark.measureframe.taskRows", str(limit))
    try:
        found = n.ae_fit(
            m.repartition(parts), feats, ["fov", "cell"], "treatment", "AE Simulator 1-3", epochs=3, batch_sizes=[128, 50],
            learning_rates=[1e-2], checkpoint_interval=2, seed=seed, tasks=tasks)["loss"].collect()
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.measureframe.taskRows")
    assert len(found) == 6
    for r in found:
        fitted, checked = want[int(r["Epoch"]), [g[0] for g in grid].index(int(r["Batch Size"]))]
        assert r["Training Loss"] == pytest.approx(fitted, abs=1e-9) and r["Validation Loss"] == pytest.approx(checked, abs=1e-9)


def test_a_task_keeps_its_rows_in_files(tmp_path):
    """One block is in memory at a time, in the order that the whole had."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    x, h = rng.integers(0, 3, (1000, 2)).astype(float), rng.integers(-(2**62), 2**62, 1000)
    block, fits = rng.integers(0, 3, 1000).astype(np.int32), rng.random(1000) < 0.7
    table = pa.table([pa.array(block), pa.array(h), pa.array(fits), pa.array(list(x), pa.list_(pa.float64()))], names=list("bhfx"))
    own = n._Blocks(str(tmp_path), table.to_batches(max_chunksize=64), 2)
    for k in range(3):
        here = fits & (block == k)
        assert own.rows(k).tolist() == x[here][np.argsort(h[here])].tolist()
    assert np.concatenate(list(own.held())).tolist() == x[~fits].tolist() and own.n_held == int((~fits).sum())


def test_turns_of_several_blocks_are_one_sequential_run(spark, m, monkeypatch):
    """Many blocks share a turn, so weights are handed on a bounded number of times."""
    monkeypatch.setattr(n, "_TURNS", 3)
    spark.conf.set("spark.measureframe.taskRows", "700")
    try:
        runs = [n.ae_fit(m, ["photons"], ["fov", "cell"], "treatment", "AE Simulator 1-3", epochs=2, learning_rates=[1e-2, 1e-3],
                         checkpoint_interval=2, tasks=tasks)["loss"].collect() for tasks in (1, 3)]
    finally:
        spark.conf.unset("spark.measureframe.taskRows")
    for a, b in zip(*runs):
        assert a["Training Loss"] == pytest.approx(b["Training Loss"]) and a["Validation Loss"] == pytest.approx(b["Validation Loss"])
