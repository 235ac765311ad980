"""Night grouping of a stream: windows of a day that begin at the hour that divides nights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nightly(stream: DataFrame, ts: str = "ts", hour: int = 11, late: str = "1 day") -> DataFrame:
    """night (its beginning), number and sum of values; batch and stream alike.  Later than ``late`` is dropped."""
    d = stream.withColumn("_at", F.col(ts).cast("timestamp"))
    if stream.isStreaming:
        d = d.withWatermark("_at", late)
    return d.groupBy(F.window("_at", "1 day", "1 day", f"{hour} hours").alias("w")).agg(F.count("*").alias("number"), F.sum("value").alias("total")).select(F.col("w.start").alias("night"), "number", "total")
