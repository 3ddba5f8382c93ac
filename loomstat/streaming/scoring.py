"""Fitted operators on streams: a z-score scorer and decider are stateless maps; gaps and windows use watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_stream(stream: DataFrame, *fitted) -> DataFrame:
    for op in fitted:
        stream = op.transform(stream)
    return stream


def sessions(stream: DataFrame, time: str, gap: str, series=(), delay: str = "10 minutes") -> DataFrame:
    """One row for each stretch without a gap: start, end, rows."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(*series, F.session_window(time, gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(*series, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def window_statistics(stream: DataFrame, time: str, value: str, length: str, slide: str | None = None, series=(), delay: str = "10 minutes") -> DataFrame:
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(*series, w.alias("w")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).select(*series, F.col("w.start").alias("start"), "n", "mean", "std")
