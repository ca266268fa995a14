"""The first rows of each group, orders and pages. Nulls and ties are always ordered explicitly, by id at last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions import dates, search, text
from plenum.functions.text import col
from plenum.operators import aggregates, joins, scopes


def recent_averages(committees: DataFrame, meetings: DataFrame, items: DataFrame, limit: int = 5) -> DataFrame:
    """(committee_id, word_count, duration): averages over each committee's latest meetings with minutes.

    Both look at the same meetings, the last `limit` by date; all their items count, and the duration only
    those with both times. Null where there is nothing to average. Words are summed by meeting before the
    join, and meetings are ranked within their committee.
    """
    per_item = items.groupBy("meeting_id").agg(F.sum("word_count").alias("words"), F.bool_or(F.col("minutes").isNotNull()).alias("kept"))
    held = meetings.select("id", "committee_id", "date", dates.duration().alias("seconds")).join(per_item.where("kept"), F.col("id") == F.col("meeting_id"))
    latest = Window.partitionBy("committee_id").orderBy(F.col("date").desc_nulls_last(), F.col("id").desc())
    last = held.withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= limit)
    found = last.groupBy("committee_id").agg(
        F.round(F.sum(F.coalesce("words", F.lit(0))) / F.count("*")).cast("int").alias("word_count"), F.round(F.avg("seconds")).cast("int").alias("duration")
    )
    return committees.select(F.col("id").alias("committee_id")).join(found, "committee_id", "left")


def latest_meeting(documents: DataFrame, items: DataFrame, meetings: DataFrame) -> DataFrame:
    """(document_id, meeting_id, date): the last meeting that dealt with a document, by date and id."""
    seen = joins.appearances(documents.select("id"), items, meetings.where("date is not null"))
    last = F.max(F.struct(F.col("meeting_date").alias("date"), F.col("meeting_id").alias("id"))).alias("m")
    return seen.groupBy("document_id").agg(last).select("document_id", F.col("m.id").alias("meeting_id"), "m.date")


def first_per_group(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def by_party_size(memberships: DataFrame, members: DataFrame, parties: DataFrame) -> DataFrame:
    """Current members of committees in order of their party's size, then its name, then theirs; those without party last."""
    sizes = aggregates.party_sizes(members)
    rows = joins.current_members(memberships, members, parties).join(sizes, "party_id", "left")
    return rows.orderBy(F.col("party_id").isNull(), F.coalesce("size", F.lit(0)).desc(), F.col("party_name").asc_nulls_last(), F.col("member_name").asc_nulls_last(), "member_id")


def parties_by_size(parties: DataFrame, members: DataFrame) -> DataFrame:
    """Active parties with their size, largest first, then by name."""
    rows = scopes.active(parties).join(aggregates.party_sizes(members), F.col("id") == F.col("party_id"), "left")
    return rows.select("id", "name", F.coalesce("size", F.lit(0)).alias("size")).orderBy(F.col("size").desc(), "name", "id")


def members_in_order(members: DataFrame) -> DataFrame:
    """Members of a party: regular ones first, an unknown kind being regular, then by name."""
    return members.orderBy(F.coalesce(F.col("kind").isin(scopes.CO_OPTED), F.lit(False)), F.col("name").asc_nulls_last(), "id")


def page_of_today(meetings: DataFrame, today, size: int = 25) -> DataFrame:
    """The page, counted from 1, on which a list of meetings, latest first, reaches today."""
    return meetings.agg((F.floor(F.count_if(F.col("date") >= col(today)) / size) + 1).alias("page"))


def latest_first(rows: DataFrame, c: str = "date") -> DataFrame:
    return rows.orderBy(F.col(c).desc_nulls_first(), F.col("id").desc())


def in_natural_order(items: DataFrame) -> DataFrame:
    """Agenda items by the numbers in their number: 9 before 10, 6.1 before 6.1.1."""
    return items.orderBy(text.natural_key("number"), "number", "id")


def by_rank_or(rows: DataFrame, default: int = 100) -> DataFrame:
    """By order, rows without one as if it were `default`."""
    return rows.orderBy(F.coalesce("ord", F.lit(default)), "id")


def page(rows: DataFrame, order: list[Column], number: int, size: int = 25) -> DataFrame:
    """Page `number`, from 1, of the ordered rows."""
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def suggestion_score(term: str) -> Column:
    """2 if the number starts with the term, and 1 if the title does."""
    return F.when(search.starts_with_term("number", term), 2).otherwise(0) + F.when(search.starts_with_term("title", term), 1).otherwise(0)


def suggestions(documents: DataFrame, term: str | None, most: int | None = None) -> DataFrame:
    """Documents that hold the term in title, number or text, those that start with it first."""
    term = term or ""
    hit = search.contains_term("title", term) | search.contains_term("number", term) | search.contains_term("full_text", term)
    rows = documents.where(hit).withColumn("score", suggestion_score(term)).orderBy(F.col("score").desc(), F.col("title").asc_nulls_last(), "id")
    return rows if most is None else rows.limit(most)


def minutes_hits(items: DataFrame, meetings: DataFrame, term: str | None, most: int | None = None) -> DataFrame:
    """Items with the term in their minutes, those of the latest meetings first."""
    hits = scopes.with_minutes_text(items).where(search.contains_term("minutes", term or ""))
    rows = joins.items_with_meetings(hits, meetings).orderBy(F.col("meetings_date").desc_nulls_first(), F.col("id").desc())
    return rows if most is None else rows.limit(most)


def found(documents: DataFrame, query: str, attachments: DataFrame | None = None, order: str = "relevance", stem=None) -> DataFrame:
    """Documents that match all terms of the query, with rank, one row each, in the asked order.

    Attachments count with the lowest weight; of a document with several the best rank stands. order is
    relevance or date, which means by number.
    """
    if order not in ("relevance", "date"):
        raise ValueError(f"no such order: {order}")
    wanted = search.terms(query)
    if stem is not None and wanted:
        from plenum.functions import stem as german

        wanted = german.german_terms(wanted) if stem is german.german else list(dict.fromkeys(german.stem(t) for t in wanted))
    own = search.vector(stem, A="title", B="full_text")
    if attachments is None:
        hits = documents.withColumn("_v", own)
    else:
        # each text is cut into terms once, before attachments multiply the rows
        held = attachments.where("attachable_type = 'Document'").select(F.col("attachable_id").alias("id"), search.vector(stem, C="content").alias("_c"))
        both = documents.select("id", own.alias("_d")).where("_d is not null").join(held, "id", "left")
        hits = both.select("id", F.when(F.col("_c").isNull(), F.col("_d")).otherwise(F.concat("_d", "_c")).alias("_v"))
    hits = hits.where(search.matches(F.col("_v"), wanted)).withColumn("rank", search.rank(F.col("_v"), wanted)).drop("_v")
    if attachments is not None:
        hits = documents.join(hits.groupBy("id").agg(F.max("rank").alias("rank")), "id")
    first = F.col("rank").desc() if order == "relevance" else F.col("number").desc_nulls_last()
    return hits.orderBy(first, "id")
