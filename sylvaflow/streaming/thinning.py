"""Windowed statistics over a stream of observations; the same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_statistics(stream: DataFrame, at: str, keys: list[str], value: str, width: str = "5 days", late: str = "10 days") -> DataFrame:
    """Count, mean, min and max per key and tumbling window. On a stream, rows later than `late` are dropped,
    so the state is bounded by the open windows."""
    base = stream.withColumn(at, F.col(at).cast("timestamp"))  # a watermark needs a time with zone
    base = base.withWatermark(at, late) if stream.isStreaming else stream
    out = base.groupBy(F.window(at, width), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "mean", "min", "max")
