import pytest
from pyspark.sql import functions as F

from measureframe import roles
from measureframe.functions import registry, scalar
from measureframe.functions.derive import add_constant, derivable, derive
from measureframe.operators import columns


def test_roles_and_metadata(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.0)], "g string, n int, x double")
    assert roles.categories(df) == ["g"] and roles.features(df) == ["n", "x"]
    marked = roles.mark_categories(df, ["n"])
    assert roles.categories(marked) == ["g", "n"]
    marked.write.parquet(str(tmp_path / "t"))
    assert roles.categories(spark.read.parquet(str(tmp_path / "t"))) == ["g", "n"]


def test_nan_becomes_null_and_names_with_dots(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "`a.b` double")
    assert [r[0] for r in roles.nan_to_null(df).collect()] == [None, 1.0]
    new = roles.with_columns(df, {"c.d": roles.q("a.b") + 1})
    assert new.columns == ["a.b", "c.d"]
    inf = spark.createDataFrame([(float("inf"),), (2.0,)], "x double")
    assert [r[0] for r in roles.inf_to_null(inf, ["x"]).collect()] == [None, 2.0]


def test_unique_name_and_pick(spark):
    assert roles.unique_name("x", ["x", "x_1"]) == "x_2"
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "`FAD a1%` double, `FAD a1%/b` double, z double")
    assert roles.pick_features(df, {"f": {"has": ("FAD",), "lacks": ("/",)}, "n": {"has": ("q",)}}) == {
        "f": "FAD a1%", "n": None}
    with pytest.raises(ValueError):
        roles.require(df, ["no"])


def test_derived_values(spark):
    df = spark.createDataFrame(
        [(75.0, 400.0, 25.0, 2000.0, 50.0), (0.0, 400.0, 25.0, 4400.0, 0.0)],
        "`NAD(P)H a1[%]` double, `NAD(P)H t1` double, `NAD(P)H a2[%]` double, `NAD(P)H t2` double, `FAD a1[%]` double",
    )
    rows = derive(df).collect()
    assert rows[0]["NAD(P)H tm"] == 800.0
    assert rows[0]["NAD(P)H a2[%]/a1[%]"] == pytest.approx(1 / 3)
    assert rows[1]["NAD(P)H a2[%]/a1[%]"] is None
    assert rows[1]["NADPH %"] == 100.0 and rows[1]["NADH %"] == 0.0
    assert rows[0]["FLIRR"] == 0.5 and rows[1]["FLIRR"] is None
    assert "NADPH/NADH" not in derive(df).columns  # its second input comes later in the order
    done, skipped = derivable(df.columns)
    assert "trp tm" in skipped and "FLIRR" in done


def test_efficiency_and_distance(spark):
    df = spark.createDataFrame([(50.0,), (0.0,), (200.0,), (100.0,)], "e double")
    got = [r[0] for r in df.select(scalar.distance_r(F.col("e"))).collect()]
    assert got[0] == pytest.approx(2.1) and got[1] is None and got[2] is None and got[3] == 0.0
    row = df.limit(1).select(
        scalar.e_perc_single(F.lit(1550.0)), scalar.e_perc_pair(F.lit(1.0), F.lit(0.0)),
        scalar.e_perc_single(F.lit(1.0), 0), scalar.from_db(scalar.to_db(F.lit(7.0))),
    ).first()
    assert row[0] == 50.0 and row[1] is None and row[2] is None and row[3] == pytest.approx(7.0)


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`Exc1_-Ch2-_t1` int, `Exc2_-x` int, ` ` int, b int")
    assert columns.renamed_headers(df.columns) == {"Exc1_-Ch2-_t1": "NAD(P)H t1"}
    out = columns.drop_columns(columns.rename_columns(df))
    assert out.columns == ["NAD(P)H t1", "b"]
    assert columns.dropped_headers(["ab", "ba"], ["a"], "startswith") == ["ab"]
    assert columns.dropped_headers(["ab", "ba"], ["a"], "endswith") == ["ba"]
    assert columns.dropped_headers(["ab", "a"], ["a"], "is") == ["a"]


def test_labels(spark):
    df = spark.createDataFrame([("007", "x", 1.0), (None, "y", 2.0)], "c string, d string, v double")
    combined = columns.combine_categories(df).collect()
    assert [r["c-d"] for r in combined] == ["007-x", None]
    assert [r["c"] for r in columns.rename_values(df, "c").collect()] == ["7", None]
    renamed = columns.map_values(df, "d", {"x": "z"})
    assert [r["d"] for r in renamed.collect()] == ["z", "y"] and "d" in roles.categories(renamed)
    assert columns.reorder_columns(df.select("v", "d", "c")).columns == ["c", "d", "v"]
    assert columns.reorder_columns(df, ["v"]).columns == ["v", "c", "d"]
    assert add_constant(df, "v", "w", 1.5).columns == ["c", "d", "v", "w"]
    assert columns.round_view(df.select((F.col("v") / 3).alias("v")), 2).first()[0] == 0.33


def test_registry():
    @registry.register("column", "twice_for_test")
    def twice(col):
        return col * 2

    assert registry.lookup("column", "twice_for_test") is twice
    with pytest.raises(ValueError):
        registry.register("column", "twice_for_test")(twice)
    with pytest.raises(KeyError):
        registry.lookup("table", "nothing")
