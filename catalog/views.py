"""The measurement-shaped view over ``lineitem`` that most checks read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from measureframe.roles import mark_categories

MEASUREMENT_SQL = """
SELECT l_orderkey AS row_key, l_linenumber AS line_no,
  l_returnflag AS fov, l_linestatus AS compartment,
  CAST(l_suppkey % 10 AS VARCHAR) AS cell,
  CASE l_linenumber WHEN 1 THEN 'Ctrl' WHEN 2 THEN 'T15' WHEN 3 THEN 'T30'
                    WHEN 4 THEN 'T45' ELSE 'T60' END AS treatment,
  100 - l_discount*500 AS nadph_a1p, l_discount*500 AS nadph_a2p,
  l_quantity*20 AS nadph_t1, 2000 + l_extendedprice/20 AS nadph_t2,
  l_tax*1000 AS fad_a1p, 100 - l_tax*1000 AS fad_a2p,
  l_quantity*25 AS fad_t1, 1000 + l_extendedprice/25 AS fad_t2,
  CASE WHEN l_quantity < 3 THEN NULL ELSE l_quantity END AS photons
FROM lineitem
"""

# Standard names of the view's columns, for the derived columns.
STANDARD_NAMES = {
    "NAD(P)H a1[%]": "nadph_a1p", "NAD(P)H a2[%]": "nadph_a2p",
    "NAD(P)H t1": "nadph_t1", "NAD(P)H t2": "nadph_t2",
    "FAD a1[%]": "fad_a1p", "FAD a2[%]": "fad_a2p", "FAD t1": "fad_t1", "FAD t2": "fad_t2",
    "trp t1": "nadph_t1", "trp t2": "nadph_t2",
    "NAD(P)H tm": "nadph_tm", "NAD(P)H a2[%]/a1[%]": "nadph_ratio",
    "NADPH %": "nadph_perc", "NADH %": "nadh_perc",
    "FAD tm": "fad_tm", "FAD a1[%]/a2[%]": "fad_ratio", "NAD(P)H tm/FAD tm": "tm_ratio",
    "FLIRR": "flirr", "trp E%2": "e_pair", "trp E%3": "e_single", "trp r2": "r_pair", "trp r3": "r_single",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    treatment = (
        F.when(n == 1, "Ctrl").when(n == 2, "T15").when(n == 3, "T30").when(n == 4, "T45").otherwise("T60")
    )
    quantity, price = F.col("l_quantity"), F.col("l_extendedprice")
    view = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("row_key"), n.alias("line_no"),
        F.col("l_returnflag").alias("fov"), F.col("l_linestatus").alias("compartment"),
        (F.col("l_suppkey") % 10).cast("string").alias("cell"), treatment.alias("treatment"),
        (100 - F.col("l_discount") * 500).alias("nadph_a1p"), (F.col("l_discount") * 500).alias("nadph_a2p"),
        (quantity * 20).alias("nadph_t1"), (2000 + price / 20).alias("nadph_t2"),
        (F.col("l_tax") * 1000).alias("fad_a1p"), (100 - F.col("l_tax") * 1000).alias("fad_a2p"),
        (quantity * 25).alias("fad_t1"), (1000 + price / 25).alias("fad_t2"),
        F.when(quantity >= 3, quantity).alias("photons"),
    )
    return mark_categories(view, ["fov", "compartment", "cell", "treatment"])
