import numpy as np
import pandas as pd
import pytest

from measureframe.operators import summary
from measureframe.roles import nan_to_null


def test_all_aggregates_against_numpy(m):
    got = summary.summarize(m, ["fov", "treatment"], ["photons", "nadph_t2"]).toPandas()
    pdf = m.toPandas()
    for _, row in got.iterrows():
        x = pdf[(pdf.fov == row.fov) & (pdf.treatment == row.treatment)].photons.dropna().to_numpy()
        want = [
            len(x), x.min(), x.max(), x.mean(), x.std(ddof=1), x.std(ddof=1) / np.sqrt(len(x)),
            np.median(x), np.percentile(x, 25), np.percentile(x, 75), x.sum(),
        ]
        assert [row[f"photons__{a}"] for a in summary.AGGREGATES] == pytest.approx(want)


@pytest.mark.parametrize("grouping", [["fov", "treatment"], []])
def test_sliced_quantiles_equal_the_plain_ones(m, spark, grouping):
    plain = summary.summarize(m, grouping, ["photons", "nadph_t2"]).toPandas()
    spark.conf.set("spark.measureframe.taskRows", "10")
    try:
        sliced = summary.summarize(m, grouping, ["photons", "nadph_t2"]).toPandas()
        only = summary.summarize(m, grouping, ["photons"], ["median"]).toPandas()
    finally:
        spark.conf.unset("spark.measureframe.taskRows")
    if grouping:
        plain, sliced, only = (d.sort_values(grouping).reset_index(drop=True) for d in (plain, sliced, only))
    pd.testing.assert_frame_equal(plain, sliced)
    assert only["photons__median"].tolist() == pytest.approx(plain["photons__median"].tolist())


def test_missing_values_and_groups(missing, spark):
    df = nan_to_null(missing)
    rows = {r["g"]: r for r in summary.summarize(df, "g").collect()}
    assert set(rows) == {"a", "b"}
    assert rows["b"]["x__sum"] == 0.0 and rows["b"]["x__count"] == 0 and rows["b"]["x__median"] is None
    assert None in {r["g"] for r in summary.summarize(df, "g", keep_null_groups=True).collect()}
    spark.conf.set("spark.measureframe.taskRows", "1")
    try:
        rows = {r["g"]: r for r in summary.summarize(df, "g").collect()}
        assert rows["a"]["x__median"] == 2.0 and rows["b"]["x__median"] is None
    finally:
        spark.conf.unset("spark.measureframe.taskRows")
    assert summary.summarize(df.limit(0), "g").count() == 0
    assert summary.summarize(df.limit(0)).first()["x__count"] == 0
    with pytest.raises(ValueError):
        summary.summarize(df, "g", aggs=["mode"])


def test_approximate_quantiles_stay_close(m):
    exact = summary.summarize(m, (), ["nadph_t2"], ["median"]).first()[0]
    close = summary.summarize(m, (), ["nadph_t2"], ["median"], quantiles="approx").first()[0]
    assert close == pytest.approx(exact, rel=0.01)


def test_reference_group_has_mean_one(m):
    out = summary.relative_change(m, ["fov", "treatment"], ["photons"], "treatment", "Ctrl")
    means = out.filter("treatment = 'Ctrl'").groupBy("fov").avg("rel photons").collect()
    assert [r[1] for r in means] == pytest.approx([1.0] * 3)
    whole = summary.relative_change(m, "treatment", ["photons"], "treatment", "Ctrl")
    assert whole.filter("treatment = 'Ctrl'").agg({"rel photons": "avg"}).first()[0] == pytest.approx(1.0)
    assert whole.count() == m.count()


def test_relative_change_without_reference(spark):
    df = spark.createDataFrame([("a", "c", 2.0), ("a", "t", 4.0), ("b", "t", 5.0), (None, "t", 1.0)], "g string, s string, v double")
    rows = {(r["g"], r["s"]): r["rel v"] for r in summary.relative_change(df, "g", "v", "s", "c").collect()}
    assert rows == {("a", "c"): 1.0, ("a", "t"): 2.0, ("b", "t"): None, (None, "t"): None}


def test_bins_are_right_closed(spark):
    values = [-100000.0, 50.0, 50.1, 75.0, 100000.0, 100001.0, None]
    df = spark.createDataFrame([("c", v) for v in values], "k string, x double")
    bins = [(-100000, 50, "low"), (50, 75, "medium"), (75, 100000, "high")]
    out = summary.categorize(df, "x", bins, "level")
    assert out.columns == ["k", "level", "x"]
    got = [r["level"] for r in out.collect()]
    assert got == ["unassigned", "low", "medium", "medium", "high", "unassigned", "unassigned"]
    assert summary.categorize(df, "x", bins, "level", merge_input=False).columns == ["k", "level"]


def test_mean_error_variants(m):
    one = summary.mean_error(m, (), ["photons", "nadph_t1"], "std", "100% stacked", "+").first()
    assert one["photons__mean"] + one["nadph_t1__mean"] == pytest.approx(100.0)
    assert one["photons__lower error"] == 0.0
    assert summary.mean_error(m, "fov", "photons", error_bar="None").columns == ["fov", "photons__mean"]
    bars = summary.bar_table(m, ["treatment", "fov"], "photons")
    assert bars.count() == 3 and "photons__mean__Ctrl" in bars.columns


def test_group_transform(m):
    out = summary.group_transform(m, "fov", "photons")
    assert out.count() == m.count()
    assert out.select("fov", "mean photons").distinct().count() == 3


def test_group_transform_without_grouping_and_with_a_missing_key(missing):
    df = nan_to_null(missing)
    assert {r["mean x"] for r in summary.group_transform(df, [], "x").collect()} == {3.5}
    assert [(r["g"], r["max x"]) for r in summary.group_transform(df, "g", "x", "max").collect() if r["g"] is None] == [(None, None)]


def test_change_labels(spark):
    rows = [("1", "c", 10.0), ("1", "t", 15.0), ("2", "c", 10.0), ("2", "t", 8.0), ("3", "t", 1.0)]
    df = spark.createDataFrame(rows, "g string, s string, v double")
    table, labelled = summary.categorize_by_change(df, ["s", "g"], "v", {"s": "c"}, [-100, 0, 100], ["down", "up"])
    got = {r["g"]: (r["t rel %"], r["Category"]) for r in table.collect()}
    assert got == {"1": (50.0, "up"), "2": (-20.0, "down")}
    assert {(r["g"], r["Category"]) for r in labelled.collect()} == {("1", "up"), ("2", "down"), ("3", "unassigned")}


def test_registered_aggregates(m):
    import pandas as pd
    from pyspark.sql import functions as F

    from measureframe.functions import registry

    if "spread_for_test" not in registry.names("aggregate"):
        @registry.register("aggregate", "spread_for_test")
        def spread(col):
            return F.max(col) - F.min(col)

        @F.pandas_udf("double")
        def middle(x: pd.Series) -> float:
            return float((x.max() + x.min()) / 2)

        registry.register("aggregate", "middle_for_test")(middle)
    row = summary.summarize(m, (), "photons", ["max", "spread_for_test", "median"]).first()
    assert row["photons__spread_for_test"] == row["photons__max"] - 3
    rows = summary.summarize(m, "fov", "photons", ["min", "max", "middle_for_test"]).collect()
    assert all(r["photons__middle_for_test"] == (r["photons__min"] + r["photons__max"]) / 2 for r in rows)


def test_group_results_join_the_rows_in_a_stage_of_their_own(m):
    """Otherwise the rows of a group are sorted in one task for the join."""
    from measureframe.operators import distributions, joins, summary

    means = summary.summarize(m, ["fov"], "photons", ["mean"])
    for out in (
        summary.relative_change(m, ["fov"], ["photons"], "treatment", "Ctrl", "median"), summary.relative_change(m, ["fov"], ["photons"], "treatment", "Ctrl"),
        summary.group_transform(m, ["fov"], ["photons"]), distributions.box_outliers(m, "photons", "fov"), joins.join_labels(m, means, ["fov"]),
    ):
        assert "RebalancePartitions" in out._jdf.queryExecution().optimizedPlan().toString()
