import numpy as np
import pytest

from measureframe.operators import series


def test_names():
    label, points = series.series_names(["F__mean__Ctrl", "F__mean__T15"])
    assert label == "F__mean" and points == ["Ctrl", "T15"]


def test_wide_row_with_a_gap(spark):
    df = spark.createDataFrame([("g", 1.0, 3.0, None, 6.0)], "k string, v__a double, v__b double, v__c double, v__d double")
    row = series.series_analysis(df, ["v__a", "v__b", "v__c", "v__d"], series.ALL_PARTS).first().asDict()
    assert row["v__Series min"] == 1.0 and row["v__Series max-min"] == 5.0
    assert row["v__Series mean"] == pytest.approx(10 / 3) and row["v__Series median"] == 3.0
    assert row["v__delta a:b"] == 2.0 and row["v__delta b:c"] is None and row["v__delta c:d"] is None
    assert row["v__cumulative delta a:b"] == 2.0 and row["v__cumulative delta a:c"] is None
    # The last running sum is missing, so no share of it exists.
    assert row["v__normalized delta a:b"] is None
    assert row["v__delta sum"] == 2.0 and row["v__delta min"] == 2.0


def test_constant_row_has_no_share(spark):
    df = spark.createDataFrame([("g", 1.0, 1.0)], "k string, v__a double, v__b double")
    row = series.series_analysis(df, ["v__a", "v__b"], merge_input=True).first()
    assert row["v__normalized delta a:b"] is None and row["v__a"] == 1.0


def _long(spark):
    rng = np.random.default_rng(1)
    rows = [(g, int(t), float(v)) for g in "ab" for t, v in zip(rng.permutation(100), rng.normal(size=100))]
    rows += [("a", 200, None), ("a", 201, 5.0), (None, 1, 1.0)]
    return spark.createDataFrame(rows, "g string, t int, v double")


def test_long_series_carried_over_slices(spark, sliced):
    got = series.series_analysis_long(_long(spark), "g", "t", "v").toPandas()
    pdf = _long(spark).toPandas().dropna(subset=["g"]).sort_values(["g", "t"])
    for g, part in pdf.groupby("g"):
        mine = got[got.g == g].sort_values("t").reset_index(drop=True)
        delta = part.v.diff()
        run = delta.cumsum()
        assert mine["delta"].to_numpy() == pytest.approx(delta.to_numpy(), nan_ok=True)
        assert mine["cumulative delta"].to_numpy() == pytest.approx(run.to_numpy(), nan_ok=True)
        share = (delta / delta.sum()).to_numpy()
        assert mine["normalized delta"].to_numpy() == pytest.approx(share, nan_ok=True)
