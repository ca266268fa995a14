"""The request log: append, and what it tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.text import col


def masked(ip) -> Column:
    """An address without its host part: the last number of IPv4, the last five groups of IPv6."""
    four = F.regexp_replace(col(ip), r"^(\d+\.\d+\.\d+)\.\d+$", "$1.0")
    return F.when(F.contains(col(ip), F.lit(":")), F.concat(F.array_join(F.slice(F.split(col(ip), ":"), 1, 3), ":"), F.lit("::"))).otherwise(four)


def track(requests: DataFrame, path: str) -> None:
    """Append requests(ip, name, params as a struct or map, time) to the log, addresses masked, parameters as JSON."""
    requests.select(masked("ip").alias("ip"), "name", F.to_json("params").alias("properties"), "time").write.mode("append").parquet(path)


def visits(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "4 hours") -> DataFrame:
    """(key, started_at, ended_at, events): runs of a visitor's events without a pause of `gap`."""
    counted = events.groupBy(F.session_window(time, gap).alias("w"), F.col(key)).agg(F.count("*").alias("events"), F.max(time).alias("ended_at"))
    return counted.select(key, F.col("w.start").alias("started_at"), "ended_at", "events")
