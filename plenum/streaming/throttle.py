"""Requests per key and fixed window, and what goes over the limit; the same plan for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT, PERIOD, LATE = 300, "5 minutes", "10 minutes"


def windows(events: DataFrame, key: str = "user_id", time: str = "ts", period: str = PERIOD, limit: int = LIMIT) -> DataFrame:
    """(key, window_start, requests, throttled) of each key and window."""
    counted = events.groupBy(F.window(time, period).alias("w"), F.col(key)).agg(F.count("*").alias("requests"))
    return counted.select(key, F.col("w.start").alias("window_start"), "requests", (F.col("requests") > limit).alias("throttled"))


def stream(events: DataFrame, key: str = "user_id", time: str = "ts", period: str = PERIOD, limit: int = LIMIT, late: str = LATE) -> DataFrame:
    """As windows, over a stream whose rows may be `late`; times without zone are taken as the session's."""
    return windows(events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late), key, time, period, limit)


def read_events(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Event files as they land, `files` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run(stream_: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what has landed, into Parquet below out, and stop. The checkpoint keeps the place for the next run."""
    query = stream_.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def flagged(events: DataFrame, key: str = "user_id", time: str = "ts", period: str = PERIOD, limit: int = LIMIT) -> DataFrame:
    """Events with whether they are let through: those beyond a window's limit are not, in order of time and id."""
    from pyspark.sql import Window

    order = Window.partitionBy(key, F.window(time, period)).orderBy(time, "event_id")
    return events.withColumn("allowed", F.row_number().over(order) <= limit)
