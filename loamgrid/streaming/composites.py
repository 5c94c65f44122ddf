"""Scenes that arrive over time: running figures per pixel and day.

Observations later than LATE are dropped by the watermark; a scene read twice counts
once, as its event id is kept until then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "2 days"


def daily(observations: DataFrame, time: str = "ts", key: str = "event_id", pixel: str = "user_id", value: str = "value") -> DataFrame:
    """A stream (or table) of observations to (day, pixel, n, total, low, high)."""
    once = observations.withWatermark(time, LATE).dropDuplicatesWithinWatermark([key]) if observations.isStreaming else observations.dropDuplicates([key])
    g = once.groupBy(F.window(time, "1 day").alias("w"), F.col(pixel).alias("pixel")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return g.select(F.col("w.start").alias("day"), "pixel", "n", F.round("total", 6).alias("total"), "low", "high")


def running(spark, schema, path: str, out: str, checkpoint: str):
    """Starts the stream from a folder of Parquet files to another one, exactly once."""
    stream = daily(spark.readStream.schema(schema).parquet(path))
    return stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
