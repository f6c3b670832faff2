"""Group summaries per time window on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from measureframe.roles import SEP, as_list, join_name, q


def stream_summary(
    stream: DataFrame,
    time: str,
    feature: str,
    grouping: str | Sequence[str] = (),
    window: str = "1 day",
    slide: str | None = None,
    watermark: str = "1 hour",
    sep: str = SEP,
) -> DataFrame:
    """Count, mean, std, min and max per window and group.

    Every aggregate has a constant-size state; rows later than the watermark are
    not counted once their window is closed.
    """
    timed = stream.select(
        q(time).cast("timestamp").alias(time), q(feature), *[q(k) for k in as_list(grouping)]
    ).withWatermark(time, watermark)
    span = F.window(q(time), window, slide) if slide else F.window(q(time), window)
    x = q(feature)
    return (
        timed.groupBy(span.alias("window"), *[q(k) for k in as_list(grouping)])
        .agg(
            F.count(x).alias(join_name(feature, "count", sep=sep)),
            F.avg(x).alias(join_name(feature, "mean", sep=sep)),
            F.stddev_samp(x).alias(join_name(feature, "std", sep=sep)),
            F.min(x).alias(join_name(feature, "min", sep=sep)),
            F.max(x).alias(join_name(feature, "max", sep=sep)),
        )
        .select(
            F.col("window.start").alias("window start"), F.col("window.end").alias("window end"),
            *[q(k) for k in as_list(grouping)],
            *[q(join_name(feature, a, sep=sep)) for a in ("count", "mean", "std", "min", "max")],
        )
    )


def summary_to_files(summary: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start a query that writes each micro-batch's changed windows to ``<path>/batch=<number>``.

    A batch that runs again, after a failure or a restart from the checkpoint, overwrites its own folder, so the
    files are the same as without the failure.  Nothing goes through the driver.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = summary.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_summary(spark: SparkSession, path: str, grouping: str | Sequence[str] = ()) -> DataFrame:
    """The latest row of every window and group in the files of ``summary_to_files``."""
    rows = spark.read.option("basePath", path).parquet(path)
    keys = ["window start", "window end", *as_list(grouping)]
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    latest = rows.groupBy(*[q(k) for k in keys]).agg(F.max_by(F.struct(*[q(c) for c in rest]), "batch").alias("_last"))
    return latest.select(*[q(k) for k in keys], *[F.col("_last")[c].alias(c) for c in rest])
