"""Incremental ingest: landed pages to tables, in micro-batches that can be run again."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.functions import text
from plenum.operators import joins, locate, scopes
from plenum.sources import records


def work_off(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run step on every micro-batch of what has landed, then stop."""
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def landed(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """A stream of landed pages: (path, id, source); the id is the number in the file's name."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).load(path)
    return raw.select("path", F.regexp_extract("path", r"(\d+)[^/]*$", 1).cast("bigint").alias("id"), F.decode("content", encoding).alias("source"))


def papers(batch: DataFrame) -> DataFrame:
    """Landed paper pages as rows of documents with their full text."""
    rows = records.parsed(batch, "paper").where("row = 0").drop("row")
    return rows.withColumnRenamed("id", "ext_id").withColumn("full_text", text.full_text("content", "resolution"))


def into(path: str) -> Callable[[DataFrame, int], None]:
    """A step that writes each batch to a folder of its own number, so that a repeated batch replaces itself."""
    return lambda batch, number: papers(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")


def locations(documents: DataFrame, streets: DataFrame, districts: DataFrame, stored: DataFrame, cache: DataFrame, handled: DataFrame) -> DataFrame:
    """(document_id, ...location): the chain from texts to places: extract, leave out local areas, resolve."""
    names = locate.dictionary(streets, scopes.blocked_names(districts))
    texts = documents.select("id", "district_id", F.concat_ws(" ", "title", "full_text").alias("text"))
    found = locate.street_matches(texts, names).select(F.col("id").alias("document_id"), "name")
    kept = locate.without_local_areas(found, handled).join(texts.select(F.col("id").alias("document_id"), "district_id"), "document_id")
    places = locate.resolved(kept, stored, streets, cache, districts)
    return kept.join(places.withColumnRenamed("name", "place").withColumnRenamed("extracted_name", "name"), ["district_id", "name"])


def _due(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select("district_id", F.lit(kind).alias("kind"), "id")


def todays(meetings: DataFrame, today) -> DataFrame:
    """(district_id, kind, id) of the meetings to visit through the day."""
    return _due(meetings.where(F.col("date") == text.col(today)), "meeting")


def changing(documents: DataFrame, meetings: DataFrame, now) -> DataFrame:
    """(district_id, kind, id) of the often changing: documents made within a week that need an update, meetings from two weeks ago on."""
    fresh = documents.where(F.col("created_at") >= F.timestamp_add("DAY", F.lit(-7), text.col(now)))
    held = meetings.where(F.col("date") >= F.date_sub(text.col(now).cast("date"), 14))
    return _due(scopes.needs_update(fresh, now), "document").union(_due(held, "meeting"))


def slowly_changing(meetings: DataFrame, items: DataFrame, today) -> DataFrame:
    """(district_id, kind, id) of the seldom changing: meetings of 30 or more days ago, however old, without a logged item, and incomplete items."""
    past = meetings.where(F.col("date") <= F.date_sub(text.col(today), 30))
    open_ = scopes.incomplete(items, meetings, today).select("id", "meeting_id").join(meetings.select(F.col("id").alias("meeting_id"), "district_id"), "meeting_id")
    return _due(joins.without_logged_items(past, items), "meeting").union(_due(open_, "item"))


def work_list(documents: DataFrame, meetings: DataFrame, items: DataFrame, now) -> DataFrame:
    """(district_id, tier, kind, id): what to visit again in each district: of today, changing, slowly changing.

    A row may stand in several tiers, which are visited at different times.
    """
    today = text.col(now).cast("date")
    tiers = {"today": todays(meetings, today), "changing": changing(documents, meetings, now), "slow": slowly_changing(meetings, items, today)}
    return reduce(DataFrame.union, [rows.select("district_id", F.lit(tier).alias("tier"), "kind", "id") for tier, rows in tiers.items()])
