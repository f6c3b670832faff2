from measureframe.operators import filters
from measureframe.operators.filters import RangeFilter
from measureframe.roles import nan_to_null


def test_range_is_inclusive_and_missing_optional(missing):
    df = nan_to_null(missing)
    assert filters.range_filter(df, "x", 1, 4).count() == 3
    assert filters.range_filter(df, "x", 1, 4, dropna=False).count() == 4
    assert filters.range_filter(df, "unknown", 1, 4).count() == 5


def test_reversed_range_is_empty_and_limits_may_be_in_either_order(missing):
    df = nan_to_null(missing)
    assert filters.range_filter(df, "x", 4, 1).count() == 0
    assert filters.range_filter(df, "x", 4, 1, dropna=False).count() == 1
    assert RangeFilter("x", 1, 9, lowest=80, highest=2).bounds() == (2, 9)
    assert RangeFilter("x", 1, 9, lowest=3).bounds() == (3, 9) and RangeFilter("x", 1, 9, highest=5).bounds() == (1, 9)
    assert filters.filter_table(df, [RangeFilter("x", 0, 9, True, lowest=2)]).count() == 3


def test_discarded_is_the_complement(m):
    ranges = [RangeFilter("photons", 5, 30, True), RangeFilter("nadph_t2", 2500, 6000, True)]
    wanted = {"treatment": ["Ctrl", "T15"]}
    kept = filters.filter_table(m, ranges, wanted)
    gone = filters.discarded(m, ranges, wanted)
    assert kept.count() + gone.count() == filters.category_filter(m, wanted).count()
    report = {r["filter"]: r["rows"] for r in filters.filter_report(filters.category_filter(m, wanted), ranges).collect()}
    assert report["all dropped"] == gone.count() and report["remaining"] == kept.count()


def test_predicates_reach_the_scan(spark):
    from catalog.views import measurements

    plan = filters.filter_table(
        measurements(spark, "/root/testdata/sf0.001"), [], {"fov": ["A"]}
    ).select("photons")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "l_returnflag" in plan.split("PushedFilters:")[1]
    assert "l_extendedprice" not in plan.split("ReadSchema")[1]


def test_defaults_apply_only_on_request(spark):
    df = spark.createDataFrame([(5.0,), (50.0,)], "`NAD(P)H a1` double")
    assert filters.filter_table(df).count() == 2
    assert filters.filter_table(df, use_defaults=True).count() == 1
    assert filters.filter_table(df, [RangeFilter("NAD(P)H a1", 60, 70, True)], use=False).count() == 2
    assert len(filters.DEFAULT_RANGES) == 38
    assert sum(f.selected for f in filters.DEFAULT_RANGES.values()) == 10
    assert sum(f.selected for f in filters.CONFIGURED_RANGES.values()) == 3
    assert filters.default_ranges(df, configured=True)[0].high == 1000


def test_series_filter(spark):
    rows = [("1", "a", 1.0), ("1", "b", 2.0), ("2", "a", 3.0), (None, "a", 4.0)]
    df = spark.createDataFrame(rows, "cell string, s string, v double")
    out = filters.series_filter(df, {"s": ["a", "b", "never"]})
    # Cell 2 lacks b; a label that never occurs is not asked for; no cell, no group.
    assert sorted(r["v"] for r in out.collect()) == [1.0, 2.0, 4.0]
    kept, used, skipped, report = filters.apply_filters(
        df, [RangeFilter("v", 0, 2, True), RangeFilter("w", 0, 1, True)], {"s": ["a", "b"]})
    assert [f.name for f in used] == ["v"] and [f.name for f in skipped] == ["w"]
    assert kept.count() == 2 and report.count() == 3
