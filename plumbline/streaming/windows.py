"""The same figures over streams: moments of the error per key and event-time window, late rows within a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.columns import finite


def windowed_accuracy(stream: DataFrame, keys: Sequence[str], time: str = "ingested_at", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """keys, window_start, sample_count, bias, mean_absolute_error, root_mean_squared_error, maximum_absolute_error.

    Works on a stream (append or update mode) and on a table alike; only mergeable sums are kept as state.
    """
    t = F.col(time).cast("timestamp")
    rows = stream.where(finite("measurement") & finite("reference")).withColumn("_time", t).withWatermark("_time", late)
    e = F.col("measurement") - F.col("reference")
    out = rows.groupBy(*keys, F.window("_time", window).alias("w")).agg(
        F.count("*").alias("sample_count"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mean_absolute_error"), F.sqrt(F.avg(e * e)).alias("root_mean_squared_error"), F.max(F.abs(e)).alias("maximum_absolute_error")
    )
    return out.select(*keys, F.col("w.start").alias("window_start"), "sample_count", "bias", "mean_absolute_error", "root_mean_squared_error", "maximum_absolute_error")
