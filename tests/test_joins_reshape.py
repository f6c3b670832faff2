import pytest
from pyspark.sql import functions as F

from measureframe.operators import joins, reshape
from measureframe.roles import categories, mark_categories, value_order


@pytest.fixture
def sides(spark):
    left = spark.createDataFrame([("a", 1.0), (None, 2.0), ("c", 3.0)], "g string, v double")
    right = spark.createDataFrame([("a", "p", 10.0), (None, "q", 20.0), ("d", "r", 30.0)], "g string, h string, v double")
    return left, right


@pytest.mark.parametrize("how, n", [("left", 3), ("right", 3), ("inner", 2), ("outer", 4)])
def test_merge(sides, how, n):
    out = joins.merge_tables(*sides, how)
    assert out.columns == ["g", "h", "v_x", "v_y"]
    rows = {r["g"]: r for r in out.collect()}
    assert len(rows) == n and rows[None]["v_x"] == 2.0 and rows[None]["v_y"] == 20.0
    if how in ("right", "outer"):
        assert rows["d"]["v_x"] is None and rows["d"]["h"] == "r"


def test_merge_with_itself_and_without_shared_labels(sides, spark):
    left, _ = sides
    assert joins.merge_tables(left, left, "inner").count() == 3
    with pytest.raises(ValueError):
        joins.merge_tables(left, spark.createDataFrame([("x",)], "z string"))


def test_concat_and_zip(sides, spark):
    out = joins.concat_rows({"one": sides[0], "two": sides[1]})
    assert out.columns == ["Source", "g", "h", "v"] and out.count() == 6
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(2, 5.0, "t"), (3, 6.0, "u")], "k int, v double, s string")
    rows = {r["k"]: (r["v"], r["v_1"]) for r in joins.zip_columns([a, b], "k").collect()}
    assert rows == {1: (1.0, None), 2: (2.0, 5.0), 3: (None, 6.0)}
    assert joins.zip_columns([a, b], "k", numbers_only=False).columns == ["k", "v", "v_1", "s"]


def test_zip_refuses_a_key_that_comes_twice(spark):
    one = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0)], "k int, v double")
    two = spark.createDataFrame([(1, 5.0)], "k int, w double")
    for tables in ([one, two], [two, one]):
        with pytest.raises(Exception, match="not unique"):
            joins.zip_columns(tables, "k").collect()


def test_split_is_disjoint_and_complete(m, tmp_path, spark):
    parts = joins.split_table(m, ["fov", "treatment"])
    assert sum(p.count() for p in parts.values()) == m.count()
    assert len(joins.split_table(m.limit(50), "row_key")) == m.limit(50).select("row_key").distinct().count()
    joins.split_to(m, "fov", str(tmp_path / "split"))
    back = spark.read.parquet(str(tmp_path / "split"))
    assert back.count() == m.count()
    assert "PartitionFilters: [isnotnull" in back.filter("fov = 'A'")._jdf.queryExecution().executedPlan().toString()


def test_except_keeps_duplicates(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert [r[0] for r in joins.except_rows(df, df.filter("k = 2"), "k").collect()] == [1, 1]


def test_pivot_then_unpivot_gives_group_means(m):
    wide = reshape.pivot_table(m, "treatment", "photons")
    long = reshape.unpivot_table(wide, [c for c in wide.columns if c.startswith("photons")], "treatment", "photons")
    got = {(r["fov"], r["compartment"], r["cell"], r["treatment"]): r["photons"] for r in long.collect() if r["photons"] is not None}
    want = {
        tuple(r)[:4]: r["x"] for r in m.groupBy("fov", "compartment", "cell", "treatment").agg(F.avg("photons").alias("x")).collect()
        if r["x"] is not None
    }
    assert got == pytest.approx(want)


def test_pivot_drops_empty_rows_and_columns(spark):
    df = spark.createDataFrame(
        [("1", "a", 1.0), ("1", "a", 3.0), ("2", "b", None), ("1", None, 9.0)], "g string, s string, v double")
    out = reshape.pivot_table(df, "s", "v")
    assert out.columns == ["g", "v__a"] and [tuple(r) for r in out.collect()] == [("1", 2.0)]
    assert reshape.pivot_table(df, "s", "v", ["a", "b"], sep="\n").columns == ["g", "v\na", "v\nb"]


def test_unpivot_names(spark):
    df = spark.createDataFrame([("a", 1, 2.5)], "Category string, `V__x__y` int, `V__z` double")
    out = reshape.unpivot_table(df, ["V__x__y", "V__z"], feature_name="V")
    assert out.columns == ["Category", "Category_1", "V"]
    assert [r["Category_1"] for r in out.collect()] == ["x|y", "z"]


def test_sort_missing_last(spark):
    df = spark.createDataFrame([(None,), (2.0,), (1.0,)], "x double")
    assert [r[0] for r in reshape.sort_rows(df, "x").collect()] == [1.0, 2.0, None]
    assert [r[0] for r in reshape.sort_rows(df, "x", False).collect()] == [2.0, 1.0, None]


def test_category_order(spark):
    df = spark.createDataFrame([("lo", 1), ("hi", 2), ("odd", 3)], "s string, n int")
    out = reshape.order_categories(df, {"s": ["hi", "lo"]})
    assert [r["s"] for r in out.collect()] == ["hi", "lo", None]
    assert value_order(out, "s") == ["hi", "lo"] and categories(out) == ["s"]
    more = reshape.order_categories(df, {"s": ["hi"]}, append_unseen=True)
    assert [r["s"] for r in more.collect()] == ["hi", "lo", "odd"]


def test_outer_merge_reads_each_key_once_for_the_rows_of_the_right(spark):
    """The anti join takes distinct keys, so a key's rows are not sorted for it."""
    left = mark_categories(spark.range(1000).selectExpr("if(id % 3 = 0, null, string(id % 3)) AS k", "id AS a"), ["k"])
    right = mark_categories(spark.createDataFrame([("1", 1.0), (None, 2.0), ("9", 3.0)], "k string, b double"), ["k"])
    out = joins.merge_tables(left, right, "outer")
    assert out.count() == 1001 and [tuple(r) for r in out.filter("a is null").collect()] == [("9", None, 3.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("LeftAnti"):]
