"""One query per operator, over the given tables.  Doubles are rounded for comparison."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from catalog.views import STANDARD_NAMES, measurements, table
from measureframe.functions.derive import add_constant, derive
from measureframe.functions import scalar
from measureframe.operators import (
    columns, distributions, filters, joins, learning, networks, reshape, series, statistics, summary,
)
from measureframe.operators.filters import RangeFilter
from measureframe.plans import flows, jobs
from measureframe.plans.lineage import checkpoint_folder
from measureframe.roles import as_category, inf_to_null, q
from measureframe.sources import sink, text
from measureframe.sources.paths import parse_path
from measureframe.streaming.measurements import import_new_files
from measureframe.streaming.windows import read_summary, stream_summary, summary_to_files

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}

GROUP = ["fov", "compartment", "treatment"]
CELLS = ["treatment", "fov", "compartment", "cell"]
FEATURES = ["nadph_a2p", "nadph_t1", "nadph_t2", "fad_a1p", "photons"]
STEPS = ["Ctrl", "T15", "T30", "T45", "T60"]


def query(fn: Query) -> Query:
    _queries[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, by plain arithmetic (``round`` goes through decimals)."""
    # A mean of decimals can lie exactly between two rounded values; the nudge decides it alike
    # in both engines.  + 0.0: a negative zero is a zero.
    nudge, unit = (2e-9 if digits == 6 else 0.0), 10.0**digits
    return df.select(*[
        (F.rint((q(f.name) + nudge) * unit) / unit + 0.0).alias(f.name)
        if f.dataType.typeName() in ("double", "float") else q(f.name)
        for f in df.schema.fields
    ])


def all_queries() -> dict[str, Query]:
    return dict(_queries)


# columns and labels

@query
def derive_measures(spark, sf):
    return rounded(derive(measurements(spark, sf), names=STANDARD_NAMES))


@query
def rename_drop_reorder(spark, sf):
    df = columns.rename_columns(table(spark, sf, "orders"), {"o_order": "order ", "o_": ""})
    return rounded(columns.reorder_columns(columns.drop_columns(df, ["priority"], "endswith")))


@query
def parse_path_columns(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return parse_path(pages, "url", {"Site": r".*//(.*?)/", "Lang": r".*/(.*?)/", "Top": r"\.(.*?)/"})


@query
def combine_categories(spark, sf):
    m = measurements(spark, sf).select("row_key", "fov", "compartment", "treatment")
    return columns.combine_categories(m, [["fov", "treatment"], ["fov", "compartment", "treatment"]])


@query
def rename_values(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    return columns.rename_values(parts, "p_brand", "^Brand#?", "")


@query
def map_values(spark, sf):
    m = measurements(spark, sf).select("row_key", "treatment")
    return columns.map_values(m, "treatment", {"Ctrl": "Control", "T60": "T60+"})


@query
def scalar_functions(spark, sf):
    li = table(spark, sf, "lineitem")
    price, tax = F.col("l_extendedprice"), F.col("l_tax")
    df = li.select(
        "l_orderkey", scalar.to_db(price).alias("price_db"), scalar.from_db(tax).alias("tax_linear"),
        scalar.normalize(F.col("l_discount"), tax).alias("share"), F.col("l_quantity"),
    )
    return rounded(add_constant(df, "l_quantity", "quantity_plus", 2.5))


@query
def round_view(spark, sf):
    return columns.round_view(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), 1)


# text files

_HEADERS = {
    "nadph_a1p": "Exc1_-Ch2-_a1[%]", "nadph_a2p": "Exc1_-Ch2-_a2[%]", "nadph_t1": "Exc1_-Ch2-_t1",
    "nadph_t2": "Exc1_-Ch2-_t2", "fad_a1p": "Exc2_-Ch3-_a1[%]", "photons": "Exc2_-Ch3-_photons", "line_no": "Exc3_-unused",
}


def _text_files(spark, sf) -> str:
    """The view as raw text files, one folder per field, in a new shared folder."""
    folder = _checkpoint_folder(spark, "text")
    m = measurements(spark, sf)
    raw = m.select("fov", F.col("treatment").alias("Treatment"), "row_key", *[F.col(c).alias(h) for c, h in _HEADERS.items()])
    sink.write_table(raw, folder, "csv", ["fov"])
    return folder


def _text_spec(**options) -> text.ImportSpec:
    return text.ImportSpec(parser={"FOV": r".*/fov=(.*?)/"}, combos=[("FOV", "Treatment")], **options)


@query
def import_text(spark, sf):
    """Whole way of an import: files, path labels, renamed and dropped headers, derived columns."""
    df = text.read_measurements(spark, _text_files(spark, sf), _text_spec())
    return rounded(df.drop("Directory", "File"))


@query
def import_text_delimiters(spark, sf):
    """The same files, every character of the delimiter separating cells."""
    df = text.read_measurements(spark, _text_files(spark, sf), _text_spec(delimiter="\t;"))
    return rounded(summary.summarize(df, ["FOV", "Treatment"], ["FLIRR", "NAD(P)H tm"], ["count", "mean", "max"]))


# filters

@query
def range_filter_keepna(spark, sf):
    m = measurements(spark, sf).select("row_key", "photons")
    return filters.range_filter(m, "photons", 5, 30, dropna=False)


@query
def range_filter_dropna(spark, sf):
    m = measurements(spark, sf).select("row_key", "photons")
    return filters.range_filter(m, "photons", 5, 30)


_RANGES = [
    RangeFilter("photons", 5, 40, True), RangeFilter("nadph_t2", 2500, 6000, True),
    RangeFilter("fad_a1p", 10, 70, True), RangeFilter("nadph_t1", 0, 1, False),
]
_LIMITED = [RangeFilter("photons", 1, 40, True, lowest=45, highest=8), RangeFilter("nadph_t2", 2500, 6000, True, False, lowest=2600)]


@query
def filter_table(spark, sf):
    return rounded(filters.filter_table(measurements(spark, sf), _RANGES, {"treatment": ["Ctrl", "T30"]}))


@query
def filter_reversed(spark, sf):
    """A range whose low end lies above its high end keeps no value, only missing ones."""
    return rounded(filters.filter_table(measurements(spark, sf), [RangeFilter("photons", 70, 10, True, False)]))


@query
def filter_limited(spark, sf):
    return rounded(filters.filter_table(measurements(spark, sf), _LIMITED))


@query
def filter_discarded(spark, sf):
    return rounded(filters.discarded(measurements(spark, sf), _RANGES, {"treatment": ["Ctrl", "T30"]}))


@query
def filter_report(spark, sf):
    return filters.filter_report(measurements(spark, sf), _RANGES)


@query
def series_filter(spark, sf):
    m = measurements(spark, sf)
    return rounded(filters.series_filter(m, {"treatment": ["Ctrl", "T15", "T30"]}, keys=["row_key"]))


# joins and sets

def _two_tables(spark, sf):
    """Rows of the view against group means, with missing labels on both sides."""
    m = measurements(spark, sf)
    nulled = F.when(F.col("treatment") != "T60", F.col("treatment"))
    left = m.select(
        "row_key", as_category(F.col("fov"), "fov"), as_category(nulled, "treatment"),
        as_category(F.col("cell"), "cell"), F.col("photons").alias("value"),
    ).filter(F.col("treatment").isNull() | (F.col("treatment") != "T15"))
    right = m.groupBy(F.col("fov"), nulled.alias("treatment")).agg(F.avg("nadph_t1").alias("value"))
    right = right.filter(F.col("treatment").isNull() | (F.col("treatment") != "T30"))
    return left, right


@query
def merge_left(spark, sf):
    return rounded(joins.merge_tables(*_two_tables(spark, sf), "left"))


@query
def merge_right(spark, sf):
    return rounded(joins.merge_tables(*_two_tables(spark, sf), "right"))


@query
def merge_inner(spark, sf):
    return rounded(joins.merge_tables(*_two_tables(spark, sf), "inner"))


@query
def merge_outer(spark, sf):
    return rounded(joins.merge_tables(*_two_tables(spark, sf), "outer"))


@query
def concat_rows(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount")
    )
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("amount")
    )
    return joins.concat_rows({"orders": orders, "customers": customers})


@query
def zip_columns(spark, sf):
    parts = table(spark, sf, "part")
    sizes = parts.filter("p_size > 10").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    prices = parts.filter("p_size < 40").select("p_partkey", "p_type", "p_retailprice")
    return joins.zip_columns([sizes, prices], "p_partkey")


@query
def join_labels(spark, sf):
    m = measurements(spark, sf).select("row_key", "fov", "cell", "photons")
    return rounded(joins.join_labels(m, summary.summarize(m, ["fov", "cell"], "photons", ["mean"]), ["fov", "cell"]))


@query
def distinct_rows(spark, sf):
    return joins.distinct_rows(measurements(spark, sf).select("fov", "cell", "nadph_t1"))


@query
def except_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return joins.except_rows(li, table(spark, sf, "orders").filter("o_totalprice > 100000").withColumnRenamed(
        "o_orderkey", "l_orderkey"), "l_orderkey")


@query
def split_counts(spark, sf):
    parts = joins.split_table(measurements(spark, sf), "fov")
    return joins.concat_rows({
        str(k[0]): v.agg(F.count(F.lit(1)).alias("n")) for k, v in parts.items()
    })


@query
def distinct_values(spark, sf):
    return joins.distinct_values(measurements(spark, sf), "treatment")


# reshape

@query
def pivot_mean(spark, sf):
    return rounded(reshape.pivot_table(measurements(spark, sf), "treatment", ["nadph_t2", "photons"]))


@query
def pivot_two_keys(spark, sf):
    return rounded(reshape.pivot_table(measurements(spark, sf), ["treatment", "fov"], "nadph_a2p"))


@query
def unpivot(spark, sf):
    m = measurements(spark, sf).drop("line_no", "row_key")
    return rounded(reshape.unpivot_table(m, ["nadph_t1", "photons", "fad_a1p"], "channel", "value"))


@query
def sort_topk(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return reshape.top_rows(orders, ["o_totalprice", "o_orderkey"], 100)


@query
def order_categories(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    order = ["5-LOW", "3-MEDIUM", "1-URGENT", "2-HIGH"]
    out = reshape.order_categories(orders, {"o_orderpriority": order})
    return out.withColumn("place", reshape.category_rank("o_orderpriority", order))


# summaries

@query
def summarize_by_group(spark, sf):
    return rounded(summary.summarize(measurements(spark, sf), CELLS, FEATURES))


@query
def summarize_all(spark, sf):
    return rounded(summary.summarize(measurements(spark, sf), (), ["photons", "nadph_t2"]))


@query
def summarize_per_feature(spark, sf):
    return rounded(summary.summary_tables(measurements(spark, sf), GROUP, ["photons", "fad_a1p"])["photons"])


@query
def summarize_text_min(spark, sf):
    return summary.summarize(table(spark, sf, "part"), "p_brand", ["p_name", "p_size"], ["min"])


@query
def group_counts(spark, sf):
    return summary.group_counts(measurements(spark, sf), CELLS)


@query
def column_limits(spark, sf):
    return rounded(summary.column_limits(measurements(spark, sf), ["nadph_t2", "photons"], 1.05))


@query
def mean_error_sem(spark, sf):
    return rounded(summary.mean_error(measurements(spark, sf), GROUP, ["photons", "nadph_t2"]))


@query
def stacked_percent(spark, sf):
    return rounded(summary.mean_error(
        measurements(spark, sf), ["treatment", "fov"], ["nadph_a2p", "fad_a1p", "photons"], "std", "100% stacked", "+"
    ))


@query
def bar_table(spark, sf):
    return rounded(summary.bar_table(measurements(spark, sf), ["treatment", "fov"], "photons", STEPS))


@query
def relative_change_mean(spark, sf):
    m = measurements(spark, sf)
    return rounded(summary.relative_change(m, ["fov", "treatment"], ["photons", "fad_a1p"], "treatment", "Ctrl"))


@query
def relative_change_median(spark, sf):
    m = measurements(spark, sf)
    return rounded(summary.relative_change(
        m, ["fov", "compartment"], ["photons", "fad_a1p"], "treatment", "Ctrl", "median"))


@query
def relative_change_all_keys(spark, sf):
    m = measurements(spark, sf)
    return rounded(summary.relative_change(m, ["fov"], ["nadph_t2"], "treatment", "Ctrl", match="all"))


@query
def group_transform(spark, sf):
    m = measurements(spark, sf).select("row_key", "fov", "cell", "photons")
    return rounded(summary.group_transform(m, ["fov", "cell"], ["photons"], "median"))


@query
def categorize(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    bins = [(1, 10, "low"), (10, 25, "medium"), (25, 45, "high")]
    return summary.categorize(li, "l_quantity", bins, "level")


_CHANGE = dict(
    grouping=["compartment", "treatment", "fov", "cell"], feature="nadph_t2",
    normalize_to={"compartment": "F", "treatment": "Ctrl"}, bins=[-100, 0, 2, 100], labels=["down", "same", "up"],
)


@query
def change_table(spark, sf):
    return rounded(summary.change_table(measurements(spark, sf), **_CHANGE))


@query
def categorize_by_change(spark, sf):
    m = measurements(spark, sf).select("row_key", "compartment", "treatment", "fov", "cell", "nadph_t2")
    return rounded(summary.categorize_by_change(m, **_CHANGE)[1])


# series

@query
def series_wide(spark, sf):
    wide = reshape.pivot_table(measurements(spark, sf), "treatment", "photons", STEPS)
    return rounded(series.series_analysis(wide, [f"photons__{s}" for s in STEPS], series.ALL_PARTS))


@query
def series_long(spark, sf):
    return rounded(series.series_analysis_long(
        measurements(spark, sf), ["fov", "compartment", "cell"], "treatment", "photons", STEPS))


@query
def series_long_numeric(spark, sf):
    orders = table(spark, sf, "orders").withColumn("day", F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")))
    return rounded(series.series_analysis_long(orders, "o_orderpriority", "day", "o_totalprice"), 4)


# distributions

@query
def histogram(spark, sf):
    return rounded(distributions.histogram(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag"))


@query
def histogram_stacked(spark, sf):
    return rounded(distributions.histogram(
        table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", {"l_extendedprice": (0, 90000, 45)}, stacked=True))


@query
def histogram_cumulative(spark, sf):
    return rounded(distributions.histogram(
        table(spark, sf, "lineitem"), "l_quantity", (), {"l_quantity": (0, 40, 20)}, cumulative=True))


@query
def histogram_density(spark, sf):
    return rounded(distributions.histogram(
        table(spark, sf, "lineitem"), "l_quantity", "l_linestatus", {"l_quantity": (0, 40, 20)}, density=True))


@query
def kde(spark, sf):
    return rounded(distributions.kde_long(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag"), 8)


@query
def kde_wide(spark, sf):
    return rounded(distributions.kde(table(spark, sf, "lineitem"), "l_tax", "l_linestatus"), 8)


@query
def box_stats(spark, sf):
    return rounded(distributions.box_stats(measurements(spark, sf), "nadph_t2", ["fov", "treatment"]))


@query
def box_outliers(spark, sf):
    # A ratio has a long tail, so that some values lie beyond the whiskers.
    m = measurements(spark, sf).withColumn("skewed", F.exp(F.col("nadph_t2") / 1000))
    return rounded(distributions.box_outliers(m, "skewed", "fov"))


@query
def violin_stats(spark, sf):
    return rounded(distributions.violin_stats(measurements(spark, sf), "photons", "treatment")["density"], 8)


@query
def swarm_points(spark, sf):
    means = summary.summarize(measurements(spark, sf), CELLS, "photons", ["mean"])
    return rounded(distributions.swarm_points(means, "photons__mean", "treatment"))


@query
def line_sd(spark, sf):
    return rounded(distributions.line_ci(measurements(spark, sf), "treatment", "photons", "fov", "sd"))


@query
def line_normal(spark, sf):
    return rounded(distributions.line_ci(measurements(spark, sf), "treatment", "photons", "fov", 95, "normal"))


@query
def line_bootstrap(spark, sf):
    return distributions.line_ci(measurements(spark, sf), "treatment", "photons", "fov", 95, "bootstrap")


@query
def line_bootstrap_order(spark, sf):
    """The parts of the bootstrap line that do not depend on the draws."""
    out = distributions.line_ci(measurements(spark, sf), "treatment", "nadph_t2", "fov", 95, "bootstrap")
    inside = (F.col("low") < F.col("mean")) & (F.col("mean") < F.col("high"))
    return rounded(out.select("treatment", "fov", "n", "mean", inside.alias("inside")))


@query
def scatter_points(spark, sf):
    return rounded(distributions.scatter_points(measurements(spark, sf), "photons", "nadph_t2", "treatment"))


@query
def scatter_bins(spark, sf):
    return distributions.scatter_bins(measurements(spark, sf), "photons", "nadph_t2", "treatment", 40)


@query
def pair_hist(spark, sf):
    names = ["photons", "nadph_t2"]
    grid = distributions.pair_matrix(measurements(spark, sf), names, names, "treatment")
    return rounded(grid["nadph_t2", "nadph_t2"])


_PANEL = {"ratio": {"has": ("flirr",)}, "FAD": {"has": ("fad_a1p",)}, "NAD": {"has": ("nadph_a2p",)}}


@query
def ratio_panel(spark, sf):
    m = derive(measurements(spark, sf), names=STANDARD_NAMES)
    return rounded(distributions.ratio_panel(m, ["treatment", "fov"], _PANEL)["bar"])


# statistics

@query
def corr_pearson(spark, sf):
    return rounded(statistics.correlation_matrix(measurements(spark, sf), FEATURES))


@query
def corr_spearman(spark, sf):
    return rounded(statistics.correlation_matrix(measurements(spark, sf), FEATURES, "spearman"))


@query
def corr_kendall(spark, sf):
    return rounded(statistics.correlation_matrix(
        measurements(spark, sf), ["nadph_a2p", "photons", "fad_a1p"], "kendall"))


@query
def corr_spearman_continuous(spark, sf):
    return rounded(statistics.correlation_matrix(measurements(spark, sf), ["nadph_t2", "fad_t2", "photons"], "spearman"))


@query
def corr_kendall_continuous(spark, sf):
    return rounded(statistics.correlation_matrix(measurements(spark, sf), ["nadph_t2", "photons", "nadph_a2p"], "kendall"))


@query
def ks_statistic(spark, sf):
    out = statistics.ks_test(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", pvalue="asymptotic")
    return rounded(out)


@query
def ks_pvalue(spark, sf):
    out = statistics.ks_test(
        measurements(spark, sf), "photons", "treatment", ["fov", "compartment", "treatment"], pvalue="asymptotic")
    return rounded(out)


@query
def ks_default(spark, sf):
    return rounded(statistics.ks_test(measurements(spark, sf), "photons", "treatment", ["fov"]))


@query
def ks_many_labels(spark, sf):
    """The 50 quantities as labels: 1225 pairs."""
    lines = table(spark, sf, "lineitem").withColumn("l_quantity", q("l_quantity").cast("int").cast("string"))
    return rounded(statistics.ks_test(lines, "l_extendedprice", "l_quantity"))


@query
def ks_exact(spark, sf):
    return statistics.ks_test(measurements(spark, sf), "photons", "treatment", ["fov", "cell"], pvalue="exact")


# learning

@query
def standardized(spark, sf):
    m = measurements(spark, sf).select("row_key", "nadph_t2", "photons")
    return rounded(learning.standardize(m, ["nadph_t2", "photons"]))


@query
def minmax_impute(spark, sf):
    m = measurements(spark, sf).select("row_key", "treatment", "nadph_t2", "photons")
    return rounded(learning.minmax_impute(m, ["nadph_t2", "photons"], F.col("treatment") == "Ctrl"))


@query
def label_encode(spark, sf):
    return learning.label_encode(measurements(spark, sf).select("row_key", "treatment", "fov"), ["treatment", "fov"])[0]


@query
def pca_explained(spark, sf):
    return rounded(learning.pca(measurements(spark, sf), ["nadph_a2p", "fad_a1p", "photons", "nadph_t2"])[1])


@query
def pca_two(spark, sf):
    """Two features: the shares are (1 + |r|) / 2 and (1 - |r|) / 2."""
    return rounded(learning.pca(measurements(spark, sf), ["photons", "nadph_t2"], None)[1])


@query
def pca_standardized(spark, sf):
    """The z-scores that enter the components, next to the categories."""
    out = learning.pca(measurements(spark, sf), ["photons", "nadph_t2"], 1, True, True)[0]
    return rounded(out.drop("PC 1"))


@query
def pca_components(spark, sf):
    return learning.pca(measurements(spark, sf), ["nadph_a2p", "fad_a1p", "photons", "nadph_t2"])[0]


@query
def kmeans_sizes(spark, sf):
    out = learning.kmeans(measurements(spark, sf), ["nadph_a2p", "photons", "nadph_t2"], 3)
    return summary.group_counts(out, "Cluster")


@query
def kmeans_nearest(spark, sf):
    """Rows, clusters, and rows that lie nearer to another cluster's mean than to their own's."""
    feats = ["nadph_a2p", "photons"]
    out = learning.standardize(learning.kmeans(measurements(spark, sf), feats, 3, tol=0.0), feats)
    z = [f"{f}__standardized" for f in feats]
    means = out.groupBy("Cluster").agg(*[F.avg(c).alias(f"_{c}") for c in z])
    centres = means.agg(F.collect_list(F.struct("Cluster", *[F.col(f"_{c}").alias(c) for c in z]))).scalar()
    apart = F.transform("_means", lambda m: F.struct(sum((F.pow(F.col(c) - m[c], F.lit(2)) for c in z), F.lit(0.0)).alias("d"), m["Cluster"].alias("c")))
    own = F.filter(F.col("_apart"), lambda a: a["c"] == F.col("Cluster"))
    far = F.get(own, F.lit(0))["d"] > F.array_min("_apart")["d"] + 1e-9
    return out.select("Cluster", *z, centres.alias("_means")).select("Cluster", apart.alias("_apart")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("Cluster").alias("clusters"), F.count_if(far).alias("misplaced"))


@query
def forest_importance(spark, sf):
    m = measurements(spark, sf)
    return learning.random_forest(m, ["nadph_a2p", "nadph_t2", "photons", "fad_a1p"], "fov", n_trees=20, max_depth=5)[0]


@query
def group_split_counts(spark, sf):
    out = learning.group_split(measurements(spark, sf), CELLS, 0.7, series="treatment")
    return summary.group_counts(out.withColumn("training", F.col("training").cast("string")), ["training", "fov"])


# networks

# A small given model for the arithmetic check.
_WEIGHTS = [
    0.5, -0.25, 1.0, 0.75, 0.5, -1.0, 0.1, 0.2, -0.3,
    1.0, -0.5, 0.25, 0.5, 2.0, -1.0, 0.05, -0.05,
]


def _given_model(spark):
    row = ("given", "AE Simulator 1-3", ["nadph_a2p", "photons"], 1, 1, 0.0, 0.0, _WEIGHTS, [0.0, 0.0], [50.0, 50.0])
    return spark.createDataFrame([row], networks.MODEL_SCHEMA)


@query
def ae_apply(spark, sf):
    m = measurements(spark, sf).select("fov", "cell", "nadph_a2p", "photons")
    return rounded(networks.ae_apply(m, _given_model(spark))[0])


@query
def ae_encode(spark, sf):
    m = measurements(spark, sf).select("fov", "cell", "nadph_a2p", "photons")
    return rounded(networks.ae_apply(m, _given_model(spark))[1])


@query
def ae_loss(spark, sf):
    return networks.ae_fit(
        measurements(spark, sf), ["nadph_a2p", "photons"], ["fov", "compartment", "cell"], "treatment",
        network="AE Simulator 1-3", epochs=3, learning_rates=[1e-2, 1e-3], checkpoint_interval=3,
    )["loss"]


_AMPLITUDES = {"NAD": ["nadph_a1p", "nadph_a2p"], "FAD": ["fad_a1p", "fad_a2p"]}


@query
def augment_amplitudes(spark, sf):
    m = measurements(spark, sf).select("fov", "cell", "nadph_a1p", "nadph_a2p", "fad_a1p", "fad_a2p")
    feats = ["nadph_a1p", "nadph_a2p", "fad_a1p", "fad_a2p"]
    return rounded(networks.ae_augment(m, feats, ["fov", "cell"], 3, amplitudes=_AMPLITUDES))


@query
def augment_noise(spark, sf):
    m = measurements(spark, sf).select("fov", "cell", "nadph_t1", "photons")
    return networks.ae_augment(m, ["nadph_t1", "photons"], ["fov", "cell"], 2, _given_two(spark), True, 20.0)


def _given_two(spark):
    row = ("given", "AE Simulator 1-3", ["nadph_t1", "photons"], 1, 1, 0.0, 0.0, _WEIGHTS, [0.0, 0.0], [1000.0, 50.0])
    return spark.createDataFrame([row], networks.MODEL_SCHEMA)


# flows

@query
def flow_basic(spark, sf):
    return rounded(flows.flow_basic(
        measurements(spark, sf), ["treatment", "fov", "cell"], ["photons", "nadph_t2"], "Ctrl", scatter=[]
    )["Relative Stats"])


@query
def flow_basic_stats(spark, sf):
    return rounded(flows.flow_basic(
        measurements(spark, sf), ["treatment", "fov", "cell"], ["photons", "nadph_t2"], "Ctrl", scatter=[]
    )["Stats"])


_FLOW_RANGES = [RangeFilter("photons", 4, 48, True), RangeFilter("nadph_t2", 2100, 6500, True)]


@query
def flow_augment_loss(spark, sf):
    out = flows.flow_augment(
        measurements(spark, sf), ["treatment", "fov", "cell"], ["nadph_t1", "photons"], "treatment", _FLOW_RANGES,
        sets=2, epochs=2, batch_sizes=[128], learning_rates=[1e-3], weight_decays=[1e-7, 1e-8], persist=False,
    )
    return out["Best Loss"]


@query
def flow_features_ks(spark, sf):
    m = measurements(spark, sf)
    out = flows.flow_features(
        m, m.withColumn("ratio", F.try_divide("nadph_a2p", "fad_a1p")), ["treatment", "fov", "cell"],
        ["nadph_t1", "photons"], "treatment", "ratio", _FLOW_RANGES, epochs=2, batch_sizes=[128],
        learning_rates=[1e-3], weight_decays=[1e-8], persist=False,
    )
    return out["KS"]


# jobs

@query
def job_merge_pca(spark, sf):
    """A job specification with two imports: rows of both, merged with means of the second, then components."""
    folder = _text_files(spark, sf)
    spec = jobs.load_spec(json.dumps({
        "import": {"parser": {"FOV": r".*/fov=(.*?)/"}},
        "imports": {"again": {"paths": [folder]}},
        "steps": [
            {"op": "pca", "input": "merged", "args": {"features": ["FAD photons", "NAD(P)H t2"], "n_components": None}, "as": "pc"},
            {"op": "merge_tables", "inputs": {"left": "rows", "right": "means"}, "args": {"how": "inner"}, "as": "merged"},
            {"op": "concat_rows", "inputs": {"first": "data", "second": "again"}, "as": "rows"},
            {"op": "summarize", "input": "again", "args": {"grouping": ["FOV", "Treatment"], "features": ["FAD photons"], "aggs": ["mean"]}, "as": "means"},
        ],
    }))
    held = []
    tables = jobs.run_job(spark, [folder], spec, held)
    out = tables["pc explained"].withColumn("rows", F.lit(tables["merged"].count()))
    for used in held:
        used.unpersist()
    return rounded(out)


@query
def sort_rows(spark, sf):
    """Neighbours in the sorted table that are out of order: none; missing values come last."""
    m = measurements(spark, sf).select("fov", "photons")
    placed = reshape.sort_rows(m, ["fov", "photons"]).withColumn("_at", F.monotonically_increasing_id())
    # The order of a part, and its ends, tell whether the whole is sorted.
    part = F.shiftright("_at", 33)
    key = F.struct("fov", F.col("photons").isNull(), "photons")
    inside = Window.partitionBy(part).orderBy("_at")
    own = placed.withColumn("_before", F.lag(key).over(inside))
    ends = placed.groupBy(part.alias("part")).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    apart = ends.withColumn("_before", F.lag("high").over(Window.orderBy("part"))).agg(F.count_if(F.col("_before") > F.col("low")).alias("between"))
    return own.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_before") > key).alias("inside")).withColumn("between", F.lit(apart.first()[0]))


@query
def inf_to_missing(spark, sf):
    m = measurements(spark, sf).select("row_key", "line_no", "photons")
    infinite = m.withColumn("photons", F.when(F.col("photons") > 40, F.lit(float("inf"))).when(F.col("photons") < 6, F.lit(float("-inf"))).otherwise(F.col("photons")))
    return inf_to_null(infinite, ["photons"])


@query
def apply_filters(spark, sf):
    """Rows that the used ranges leave, how many ranges are used and skipped, and rows that each drops."""
    out, used, skipped, report = filters.apply_filters(measurements(spark, sf), [*_RANGES, RangeFilter("absent", 0, 1, True)], {"treatment": ["Ctrl", "T15"]})
    return out.agg(F.count(F.lit(1)).alias("n")).withColumns({"used": F.lit(len(used)), "skipped": F.lit(len(skipped)), "reported": F.lit(report.count())})


@query
def default_ranges(spark, sf):
    """The default range of each feature, applied."""
    named = measurements(spark, sf).select("row_key", F.col("nadph_t1").alias("NAD(P)H t1"), F.col("photons").alias("other"))
    ranges = {f.name: f for f in filters.default_ranges(named.drop("row_key"))}
    low, high = ranges["other"].low, ranges["other"].high
    return named.filter(F.col("other").between(low, high)).agg(F.count(F.lit(1)).alias("n"), F.lit(len(ranges)).alias("ranges"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"))


@query
def preview_rows(spark, sf):
    """At most 50 rows of each file."""
    out = text.preview(spark, _text_files(spark, sf), _text_spec(), 50)
    return out.groupBy("Directory", "File").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.count_if(F.col("n") > 50).alias("longer"))


@query
def group_split_sides(spark, sf):
    """Groups on either side of the split."""
    keys = ["fov", "compartment", "cell"]
    out = learning.group_split(measurements(spark, sf), CELLS, 0.7, series="treatment")
    return out.select(*keys, "training").distinct().agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(*[F.col(k) for k in keys]).alias("groups"), F.count_if("training").alias("training"))


@query
def pca_moments(spark, sf):
    """Scores are centred, uncorrelated, and vary by their shares; the shares sum to one."""
    feats = ["nadph_a2p", "fad_a1p", "photons", "nadph_t2"]
    scores, explained = learning.pca(measurements(spark, sf), feats, None)
    names = [f"PC {i + 1}" for i in range(4)]
    shares = explained.agg(F.map_from_entries(F.collect_list(F.struct("PC", "explained var ratio")))).scalar()
    apart = [F.abs(F.corr(a, b)) for k, a in enumerate(names) for b in names[k + 1:]]
    found = scores.select(*[q(n) for n in names], shares.alias("_shares")).agg(
        F.count(F.lit(1)).alias("n"), (F.greatest(*apart) < 1e-6).alias("uncorrelated"),
        (F.greatest(*[F.abs(F.avg(q(n))) for n in names]) < 1e-9).alias("centred"),
        (F.greatest(*[F.abs(F.var_samp(q(n)) / 4 - F.try_element_at(F.first("_shares"), F.lit(n))) for n in names]) < 1e-4).alias("as_shared"))
    return found.withColumn("total", F.lit(explained.agg(F.round(F.sum("explained var ratio"), 6)).first()[0]))


@query
def forest_sums(spark, sf):
    """Importances are not negative and sum to one; an accuracy is a share."""
    m = measurements(spark, sf)
    scores, accuracy = learning.random_forest(m, ["nadph_a2p", "nadph_t2", "photons", "fad_a1p"], "compartment", n_trees=5, max_depth=4)
    share = accuracy.select(F.col("Accuracy").between(0.4, 1.0)).scalar()
    return scores.agg(F.count(F.lit(1)).alias("features"), F.round(F.sum("Importance Score"), 6).alias("total"), (F.min("Importance Score") >= 0).alias("positive"), F.first(share).alias("accurate"))


@query
def ae_fit_tables(spark, sf):
    """The tables of a fit: epochs x grid losses that fall, kept models, rows decoded by each final model."""
    out = networks.ae_fit(
        measurements(spark, sf), ["nadph_a2p", "photons"], ["fov", "compartment", "cell"], "treatment",
        network="AE Simulator 1-3", epochs=3, learning_rates=[1e-2, 1e-3], checkpoint_interval=2)
    loss = out["loss"].groupBy("Learning Rate").agg(F.max_by("Training Loss", "Epoch").alias("last"), F.min_by("Training Loss", "Epoch").alias("first"))
    falling = loss.agg(F.bool_and(F.col("last") < F.col("first"))).scalar()
    return out["decoded"].agg(
        F.count(F.lit(1)).alias("decoded"), F.count_distinct("model_file").alias("finals"), F.count_distinct("Autoencoder").alias("sides"),
        F.first(falling).alias("falling")).withColumns({"losses": F.lit(out["loss"].count()), "models": F.lit(out["models"].count())})


# streaming

@query
def stream_import(spark, sf):
    """The text files as a stream: parsed, derived, filtered and categorised on arrival."""
    source = _text_files(spark, sf)
    columns_ = {"Treatment": "string", "row_key": "long", **{h: "double" for h in _HEADERS.values()}}
    bins = {"feature": "NAD(P)H tm", "bins": [(0, 400, "short"), (400, 1200, "middle"), (1200, 9000, "long")], "name": "kind"}
    # Rows go from the tasks to files, and from there to the reader.
    done = import_new_files(
        spark, source, _checkpoint_folder(spark, "stream_import"), columns_, _text_spec(), [RangeFilter("FAD photons", 5, 45, True)], bins)
    return rounded(done.select("FOV", "Treatment", "kind", "row_key", "FAD photons", "NAD(P)H tm", "FLIRR"))


@query
def stream_daily(spark, sf):
    """Available-now run over the events file, written batch by batch; the latest row of each window."""
    schema = table(spark, sf, "events").schema
    # Relative to the file's folder, only the events file is read.
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    counted = stream_summary(stream, "ts", "value", "event_type")
    folder = _checkpoint_folder(spark, "stream-daily")
    summary_to_files(counted, f"{folder}/out", f"{folder}/state").awaitTermination()
    latest = read_summary(spark, f"{folder}/out", "event_type")
    day = F.date_format("window start", "yyyy-MM-dd").alias("day")
    return rounded(latest.select(day, *[q(c) for c in (
        "event_type", "value__count", "value__mean", "value__std", "value__min", "value__max")]))


def _checkpoint_folder(spark, name: str) -> str:
    """A new folder in the shared checkpoint directory that the session names; a local session may use one of its own."""
    shared = checkpoint_folder(spark)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="measureframe-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4()}"
