"""Connected components of a graph whose node ids are random, as digests are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measureframe.llm.store import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b); root names the component.

    Each round points every node to the smallest of itself and its neighbours and
    contracts the edges along.  As ids are in random order, a round removes a constant
    share of the nodes of any graph, a star or a chain alike; rounds grow with the
    logarithm of the nodes.  Minima are taken map-side first, so a hub with very many
    edges is no burden; the joins have one row a node on one side.
    """
    ordered = lambda e: e.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = written(ordered(edges), "edges")
    total = None
    while left.limit(1).count():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "parents")
        if total is None:
            total = to
        else:
            step = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
            total = written(total.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        for end in ("a", "b"):
            left = left.join(to.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("root", end)
        left = written(ordered(left), "edges")
    return total if total is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
