"""Counts, sums, averages and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions import dates, geo
from plenum.functions.text import col
from plenum.operators import joins, scopes


def per_month(rows: DataFrame, value: Column | None = None, name: str = "n", date: str = "date") -> DataFrame:
    """(month, n): rows, or the sum of a value, by month. Rows that a join repeated count as often."""
    return rows.where(F.col(date).isNotNull()).groupBy(dates.month(date).alias("month")).agg((F.count("*") if value is None else F.sum(value)).alias(name))


def filled(series: DataFrame, name: str = "n") -> DataFrame:
    """A monthly series with every month between its first and last, zero where it has none."""
    ends = series.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    every = ends.where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return every.join(series, "month", "left").select("month", F.coalesce(name, F.lit(0)).alias(name))


def documents_per_month(documents: DataFrame, items: DataFrame, meetings: DataFrame) -> DataFrame:
    return per_month(joins.appearances(documents, items, meetings), name="n_appearances", date="meeting_date")


def documents_per_committee(documents: DataFrame, items: DataFrame, meetings: DataFrame) -> DataFrame:
    """(committee_id, month, n_appearances): documents on the agendas of each committee's meetings."""
    held = meetings.select(F.col("id").alias("meeting_id"), "committee_id", "date")
    seen = items.select("meeting_id", F.col("document_id").alias("id")).join(documents.select("id"), "id", "left_semi")
    return seen.join(held, "meeting_id").groupBy("committee_id", dates.month("date").alias("month")).agg(F.count("*").alias("n_appearances"))


def words_per_month(meetings: DataFrame, items: DataFrame) -> DataFrame:
    """Words of all items of meetings with minutes, by month."""
    held = joins.with_minutes(meetings, items).select(F.col("id").alias("meeting_id"), "date")
    return per_month(held.join(items.select("meeting_id", "word_count"), "meeting_id"), F.col("word_count"), "words")


def meeting_stats(items: DataFrame) -> DataFrame:
    """(meeting_id, n_items, words, logged) in one pass."""
    return items.groupBy("meeting_id").agg(F.count("*").alias("n_items"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"), F.bool_or(F.col("ext_id").isNotNull()).alias("logged"))


def party_sizes(members: DataFrame) -> DataFrame:
    """(party_id, size): active regular members; those without a party are a group."""
    return scopes.regular(scopes.active(members)).groupBy("party_id").agg(F.count("*").alias("size"))


def average_durations(meetings: DataFrame) -> DataFrame:
    """(committee_id, average_duration): over all timed meetings, in whole seconds; null without one."""
    return meetings.groupBy("committee_id").agg(F.round(F.avg(dates.duration())).cast("int").alias("average_duration"))


def ratio_of_sums(rows: DataFrame, a: str, b: str, keys: tuple = ()) -> DataFrame:
    """(sum(a) - sum(b)) / sum(a), null where nothing adds up."""
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(a) - F.sum(b), F.sum(a)).alias("ratio"))


def percent(part, whole) -> Column:
    """Whole percent, rounded down, 0 of nothing."""
    return F.when(col(whole) > 0, F.floor(F.lit(100) * col(part) / col(whole))).otherwise(F.lit(0)).cast("bigint")


def party_counts(documents: DataFrame, parties: list[str], scopes_: dict) -> DataFrame:
    """(party, <name of each scope>...): documents whose title or author names the party, in one pass over documents.

    scopes_ maps names to conditions. Parties are constants, so nothing is joined: each is a conditional count.
    """
    counts = documents.agg(*[F.count_if(scopes.by_author(p) & c).alias(f"c{k}_{name}") for k, p in enumerate(parties) for name, c in scopes_.items()])
    rows = F.array(*[F.struct(F.lit(p).alias("party"), *[F.col(f"c{k}_{name}").alias(name) for name in scopes_]) for k, p in enumerate(parties)])
    return counts.select(F.inline(rows))


def extremes(rows: DataFrame, c: str) -> DataFrame:
    return rows.agg(F.min(c).alias("least"), F.max(c).alias("most"))


def known_years(meetings: DataFrame) -> DataFrame:
    """Every year from the first to the last meeting."""
    ends = extremes(meetings.where("date is not null"), "date").where("least is not null")
    return ends.select(F.explode(F.sequence(F.year("least"), F.year("most"))).alias("year"))


def overflow(rows: DataFrame, shown: int) -> DataFrame:
    """How many rows a list of `shown` leaves out."""
    return rows.agg(F.greatest(F.count("*") - shown, F.lit(0)).alias("more"))


def grouped_rows(rows: DataFrame, keys: list[str], order: list[str], most: int | None = None, name: str = "rows") -> DataFrame:
    """The rows of each key as a list of structs in the given order, the first `most` only.

    With `most` no group is gathered: rows beyond it are dropped by rank first, which is partial per task.
    """
    if most is not None:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c) for c in order]))
        rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")
    others = [c for c in order + [c for c in rows.columns if c not in keys + order]]
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*others))).alias(name))


def lines(items: DataFrame) -> DataFrame:
    """(meeting_id, agenda): number and title of all items, a line each, in order of id."""
    line = F.concat_ws(" ", "number", "title")
    return items.groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "\n").alias("agenda"))


def clusters(points: DataFrame, size: float) -> DataFrame:
    """Points by grid cell, with their number and middle."""
    row, column = geo.cell("latitude", "longitude", size)
    return points.groupBy(row.alias("cell_row"), column.alias("cell_column")).agg(F.count("*").alias("n"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
