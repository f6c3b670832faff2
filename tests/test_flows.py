import pytest
from pyspark.sql import functions as F

from measureframe.operators.filters import RangeFilter
from measureframe.plans import flows
from measureframe.streaming.windows import stream_summary

RANGES = [RangeFilter("photons", 4, 48, True)]
GROUPS = ["treatment", "fov", "cell"]
SMALL = dict(epochs=2, batch_sizes=[64], learning_rates=[1e-2], weight_decays=[1e-8, 1e-7], checkpoint_interval=1)


def test_select_outputs():
    results = {"Table: A": 1, "Model File 2": "m_epoch0006", "Model File 1": "m_epoch0003"}
    assert flows.select_outputs(results, "Table") == [1]
    assert flows.select_outputs(results, "Model", "0006") == ["m_epoch0006"]


def test_basic(m):
    df = m.withColumnRenamed("fad_a1p", "FAD a1%").withColumnRenamed("nadph_a2p", "NAD a2%")
    out = flows.flow_basic(df, GROUPS, ["photons", "FAD a1%", "NAD a2%"], ci="sd")
    assert out["Counts"].count() == df.select(*GROUPS).distinct().count()
    assert out["Stats"].count() == 5
    assert out["Scatter NAD a2% | FAD a1%"].agg(F.sum("count")).first()[0] == df.count()
    assert {"Relative Stats", "Line rel photons", "KDE photons", "FAD-Pair FAD a1% | FAD a1%"} <= set(out)
    assert out["KDE photons"].count() == 1000


def test_augment(m):
    out = flows.flow_augment(m, GROUPS, ["photons", "nadph_t1"], "treatment", RANGES, sets=2, **SMALL)
    assert out["Best Loss"].count() == 2
    assert out["Loss Curves"].count() == 2 * 2 * 2
    names = [k for k in out if k.endswith(": Correlation")]
    assert len(names) == 2 and out[names[0]].count() == 2
    assert out["Bar Training Loss"].count() == 4
    assert out["Simulated"].count() > 0


def test_features(m):
    df = m.withColumn("ratio", F.try_divide("nadph_a2p", "fad_a1p"))
    out = flows.flow_features(
        df, df, ["treatment", "fov"], ["photons", "nadph_t1"], "treatment", "ratio", RANGES, **SMALL)
    ks = out["KS"]
    assert ks.columns[0] == "Source" and ks.select("Source").distinct().count() == 4
    # T15 is left out of the series, as its label holds 15.
    assert out["FLIRR: Series"].columns[1:4] == [
        "ratio__mean__delta Ctrl:T30", "ratio__mean__delta T30:T45", "ratio__mean__delta T45:T60"]
    first = [r[0] for r in out["FLIRR: Sorted"].select(F.col("`ratio__mean__normalized delta Ctrl:T30`")).collect()]
    assert first == sorted(first)
    assert out["PCA: Bars"].count() == 3


def test_stream_summary_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:02:00", "a", 3.0)]
    spark.createDataFrame(rows, "ts string, g string, v double").select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), "g", "v").write.parquet(source)
    row = stream_summary(spark.read.parquet(source), "ts", "v", "g", "10 minutes").first()
    assert (row["v__count"], row["v__mean"], row["v__min"], row["v__max"]) == (2, 2.0, 1.0, 3.0)
    assert row["v__std"] == pytest.approx(2**0.5)
    stream = spark.readStream.schema("ts timestamp_ntz, g string, v double").parquet(source)
    run = (
        stream_summary(stream, "ts", "v", "g", "10 minutes").writeStream.format("memory").queryName("windowed")
        .outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    assert [tuple(r) for r in spark.table("windowed").collect()] == [tuple(row)]


def test_late_rows_are_left_out(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")

    def add(*rows):
        spark.createDataFrame(rows, "ts string, v double").select(
            F.col("ts").cast("timestamp_ntz").alias("ts"), "v").write.mode("append").parquet(source)
        stream = spark.readStream.schema("ts timestamp_ntz, v double").parquet(source)
        run = (
            stream_summary(stream, "ts", "v", (), "10 minutes", watermark="10 minutes").writeStream
            .format("parquet").option("path", target).outputMode("append")
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        run.awaitTermination()

    add(("2024-01-01 00:01:00", 1.0), ("2024-01-01 02:00:00", 2.0))
    add(("2024-01-01 00:02:00", 9.0), ("2024-01-01 04:00:00", 3.0))  # the first one is too late
    got = {str(r["window start"]): r["v__count"] for r in spark.read.parquet(target).collect()}
    assert got["2024-01-01 00:00:00"] == 1 and got["2024-01-01 02:00:00"] == 1


def test_summary_files_are_the_same_after_a_batch_that_runs_again(spark, tmp_path):
    """Files arrive in three batches; one is written, forgotten by the checkpoint and run again."""

    from measureframe.streaming.windows import read_summary, summary_to_files

    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [(f"2024-01-01 00:{m:02d}:00", "a" if m % 3 else "b", float(m)) for m in range(60)]
    table = spark.createDataFrame(rows, "t string, g string, v double").select(F.to_timestamp("t").alias("ts"), "g", "v")

    def go():
        stream = spark.readStream.schema(table.schema).parquet(source)
        summary_to_files(stream_summary(stream, "ts", "v", "g", "10 minutes"), out, state).awaitTermination()

    def rounded(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())

    def found():
        return rounded(read_summary(spark, out, "g"))

    for k in range(3):
        table.filter(F.minute("ts") % 3 == k).coalesce(1).write.mode("append").parquet(source)
        go()
    want = rounded(stream_summary(table, "ts", "v", "g", "10 minutes"))
    assert found() == want
    # The last batch was written, but its commit is lost.
    (tmp_path / "state" / "commits" / "2").unlink()
    for crc in (tmp_path / "state" / "commits").glob(".2.crc"):
        crc.unlink()
    before = sorted(p.name for p in (tmp_path / "out").iterdir())
    go()
    assert found() == want and sorted(p.name for p in (tmp_path / "out").iterdir()) == before
