"""Exact duplicates by distributed MSD radix partitioning; no digest decides equality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from measureframe.llm.store import written

#: Bytes of the first digit; each further digit is so many times as wide, up to the widest.
FIRST, GROWTH, WIDEST = 64, 16, 1 << 20


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with ``keep_id``, ``group_size``, ``kept``, and the row itself in ``row``.

    Rows are split by the first bytes of their text, the groups that have more than one
    row by the next bytes, and so on until a group is a single row or its texts have
    ended.  A digit is a run of bytes that widens from round to round, so rounds grow
    with the logarithm of the longest shared start.  A round counts digits with map-side
    sums and joins the counts back, a join whose hot keys Spark can split; only rows of groups
    that are still open go on, and they are written between rounds.

    A null text counts as empty.  Of equal texts the row with the largest id stays (an id
    that is null is the smallest); of rows that repeat id and text, one.  Other columns
    may have any names.  An empty table gives no rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    body = F.coalesce(F.col("row")[text_col], F.lit("")).cast("binary")
    open_rows = docs.select(F.lit(0).cast("long").alias("grp"), F.col(id_col).alias("id"), row)
    done, start, width = [], 1, FIRST
    while True:
        rows = open_rows.withColumn("digit", F.substring(body, start, width))
        found = written(
            rows.groupBy("grp", "digit").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep_id"))
            .filter("n > 1")
            .select("grp", "digit", "n", "keep_id", (F.octet_length("digit") < width).alias("ended"), F.monotonically_increasing_id().alias("next")),
            "digits",
        )
        # A sort-merge join at every size: counts of shared digits grow with the rows, and hot digits are split.
        joined = written(rows.join(found.hint("merge"), ["grp", "digit"], "left").drop("grp", "digit"), "rows")
        alone = F.col("next").isNull()
        done.append(joined.filter(alone | F.col("ended")).select(
            "row", "id", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).alias("group_size"), F.lit(len(done)).alias("round"), "next",
        ))
        open_rows = joined.filter("not ended").select(F.col("next").alias("grp"), "id", "row")
        if not found.filter("not ended").limit(1).count():
            break
        start, width = start + width, min(width * GROWTH, WIDEST)
    every = reduce(DataFrame.union, done)
    # Rows alone and rows with a lesser id need no choice; the others compete, one for each group as a rule.
    plain = F.col("next").isNull() | ~F.col("id").eqNullSafe(F.col("keep_id"))
    first = F.row_number().over(Window.partitionBy("round", "next").orderBy(F.lit(0))) == 1
    settled = every.filter(plain).withColumn("kept", F.col("next").isNull())
    return settled.union(every.filter(~plain).withColumn("kept", first)).select("row", "keep_id", "group_size", "kept")
