"""Event rates of a running observation: the batch operator's buckets on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiray.operators.quality import utc_time


def rate_stream(
    images: DataFrame, time: str = "Timestamp", by=("Telescope",), width: int = 100, late: str = "10 minutes"
) -> DataFrame:
    """Images per second and bucket. A bucket closes once the watermark has passed it;
    unlike in the batch operator, buckets without images do not appear."""
    timed = images.withColumn("t_", utc_time(F.col(time))).withWatermark("t_", late)
    counted = timed.groupBy(F.window("t_", f"{width} seconds").alias("w"), *by).agg(F.count("*").alias("n"))
    start = F.unix_seconds(F.col("w.start")).alias("bucket")
    return counted.select(*by, start, "n", (F.col("n") / F.lit(float(width))).alias("rate"))
