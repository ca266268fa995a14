"""Joins of the domain tables along their declared paths, and those that look like theta joins but are not run as such."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.functions import text
from plenum.functions.text import col
from plenum.operators import scopes
from plenum.schemas import PATHS


def prefixed(df: DataFrame, prefix: str, keep: tuple = ()) -> DataFrame:
    """df with its columns behind a prefix, but for those to keep."""
    return df.select(*[F.col(c).alias(c if c in keep else f"{prefix}_{c}") for c in df.columns])


def along(left: DataFrame, right: DataFrame, path: tuple[str, str], how: str = "inner") -> DataFrame:
    """left joined with right along a declared path; right's columns stand behind its table's name."""
    pairs, name = PATHS[path], path[1]
    other = prefixed(right, name)
    condition = [F.col(a) == F.col(f"{name}_{b}") for a, b in pairs]
    return left.join(other, condition, how)


def items_with_meetings(items: DataFrame, meetings: DataFrame) -> DataFrame:
    return along(items, meetings, ("agenda_items", "meetings"))


def appearances(documents: DataFrame, items: DataFrame, meetings: DataFrame) -> DataFrame:
    """Each document with each meeting that dealt with it, once for each agenda item: rows fan out and stay so."""
    slim = items.select(F.col("id").alias("item_id"), "meeting_id", "document_id")
    met = prefixed(meetings.select("id", "date", "committee_id", "title"), "meeting", ("meeting_id",))
    return slim.join(met, "meeting_id").join(documents, F.col("document_id") == documents["id"])


def include_meetings(documents: DataFrame, items: DataFrame, meetings: DataFrame) -> DataFrame:
    """As appearances, with documents that no meeting dealt with."""
    slim = items.select("meeting_id", "document_id").join(prefixed(meetings.select("id", "date", "committee_id", "title"), "meeting"), "meeting_id")
    return documents.join(slim, documents["id"] == slim["document_id"], "left")


def with_attachments(owners: DataFrame, attachments: DataFrame, kind: str = "Document", how: str = "left") -> DataFrame:
    """Owners with their attachments, found by type and id; owners repeat."""
    own = attachments.where(F.col("attachable_type") == kind).select(F.col("attachable_id"), F.col("name").alias("attachment_name"), F.col("content").alias("attachment_content"))
    return owners.join(own, owners["id"] == own["attachable_id"], how)


def with_agenda(meetings: DataFrame, items: DataFrame) -> DataFrame:
    """Titled meetings that have an agenda item."""
    return scopes.complete(meetings).join(items.select(F.col("meeting_id").alias("id")), "id", "left_semi")


def with_minutes(meetings: DataFrame, items: DataFrame) -> DataFrame:
    """Meetings of which some item has minutes."""
    return meetings.join(scopes.with_minutes_text(items).select(F.col("meeting_id").alias("id")), "id", "left_semi")


def without_logged_items(meetings: DataFrame, items: DataFrame) -> DataFrame:
    return meetings.join(scopes.logged(items).select(F.col("meeting_id").alias("id")), "id", "left_anti")


def not_in(rows: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not among those seen."""
    return rows.join(seen.select(key), key, "left_anti")


def current_members(memberships: DataFrame, members: DataFrame, parties: DataFrame) -> DataFrame:
    """Active memberships of active members, with the party where there is one."""
    own = prefixed(scopes.active(members), "member")
    group = parties.select(F.col("id").alias("party_id"), F.col("name").alias("party_name"))
    return scopes.active(memberships).join(own, "member_id").withColumnRenamed("member_party_id", "party_id").join(group, "party_id", "left")


def markers(documents: DataFrame, links: DataFrame, locations: DataFrame) -> DataFrame:
    """Each document at each of its locations."""
    return links.join(prefixed(documents, "document"), "document_id").join(prefixed(locations, "location"), "location_id")


def next_meetings(committees: DataFrame, meetings: DataFrame, today) -> DataFrame:
    """Committees with their next meeting from today on: its date and id, by date and id."""
    first = scopes.in_future(meetings, today).groupBy("committee_id").agg(F.min(F.struct("date", "id")).alias("next"))
    found = first.select(F.col("committee_id").alias("id"), F.col("next.date").alias("next_date"), F.col("next.id").alias("next_meeting_id"))
    return committees.join(found, "id", "left")


def committee_by_title(untitled: DataFrame, meetings: DataFrame) -> DataFrame:
    """Meetings with the committee of an earlier meeting of the same title, the smallest id, where they have none."""
    known = meetings.where("title is not null and committee_id is not null").groupBy("title").agg(F.min_by("committee_id", "id").alias("known_committee"))
    return untitled.join(known, "title", "left").withColumn("committee_id", F.coalesce("committee_id", "known_committee")).drop("known_committee")


def cited_documents(texts: DataFrame, documents: DataFrame, content: str = "content") -> DataFrame:
    """(id, cited, position, document_id): the numbers that a text cites, in order, with the district's document of that number or null."""
    cited = texts.select("id", "district_id", F.posexplode(text.document_numbers(content)).alias("position", "cited"))
    known = documents.groupBy("district_id", F.col("number").alias("cited")).agg(F.min("id").alias("document_id"))
    return cited.join(known, ["district_id", "cited"], "left").select("id", "cited", "position", "document_id")


def related(documents: DataFrame) -> DataFrame:
    """(id, related_id): by number, the original and all its parts for a part, and its parts for an original, of the same district, not itself.

    The hierarchy is a prefix join; the part before the first dot makes it an equal one.
    """
    keyed = documents.where("number is not null").select("id", "district_id", "number", text.number_root("number").alias("root"))
    other = keyed.select(F.col("id").alias("related_id"), F.col("number").alias("related_number"), "district_id", "root")
    both = keyed.join(other, ["district_id", "root"]).where(F.col("id") != F.col("related_id"))
    child = F.startswith(F.col("related_number"), F.concat("root", F.lit(".")))
    parent = F.contains("number", F.lit(".")) & (F.col("related_number") == F.col("root"))
    return both.where(child | parent).select("id", "related_id")


def spine(first, last, step: str, spark, name: str = "day") -> DataFrame:
    """Dates from first to last by "1 day" or "1 month"; both are columns of constants."""
    return spark.range(1).select(F.explode(F.sequence(col(first), col(last), F.expr(f"interval {step}"))).alias(name))


def calendar(meetings: DataFrame, districts: DataFrame, day, today) -> DataFrame:
    """Every day of the month and district, with its meetings: day, weekend, today, district_id, district, meeting_id, title.

    The grid is each district with the days of one month; the meetings of the month come to it by
    (district, day), the large side being filtered first.
    """
    from plenum.functions.dates import month

    days = F.explode(F.sequence(month(day), F.last_day(col(day)), F.expr("interval 1 day"))).alias("day")
    grid = districts.select(F.col("id").alias("district_id"), F.col("name").alias("district"), days)
    grid = grid.select("*", F.dayofweek("day").isin(1, 7).alias("weekend"), (F.col("day") == col(today)).alias("today"))
    held = scopes.in_month(meetings, day).select("district_id", F.col("date").alias("day"), F.col("id").alias("meeting_id"), "title")
    return grid.join(held, ["district_id", "day"], "left").select("day", "weekend", "today", "district_id", "district", "meeting_id", "title")
