"""The public requests as plans over the domain tables. Each gives DataFrames, ready for as_json."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.functions import dates, geo, search, text
from plenum.functions.text import col
from plenum.operators import aggregates, joins, scopes, tops
from plenum.sources import sinks

LISTED, SHORT, SUGGESTED, NEWEST, PAGE = 25, 5, 5, 10, 25


class NotFound(LookupError):
    """A request that names what does not exist."""


@dataclass
class Council:
    """The domain tables. documents is what the public sees; all_documents has every row."""

    districts: DataFrame
    committees: DataFrame
    meetings: DataFrame
    agenda_items: DataFrame
    all_documents: DataFrame
    members: DataFrame | None = None
    memberships: DataFrame | None = None
    parties: DataFrame | None = None
    locations: DataFrame | None = None
    document_locations: DataFrame | None = None
    attachments: DataFrame | None = None

    @property
    def documents(self) -> DataFrame:
        return scopes.public(self.all_documents)

    def district(self, name: str | None) -> int | None:
        """The id of a district by its address name; None for all."""
        if not name:
            return None
        row = self.districts.where(text.parameterize("name") == F.lit(name.lower())).select("id").first()
        if row is None:
            raise NotFound("no such district")
        return row["id"]

    @staticmethod
    def slug_id(slug: str) -> int:
        """The id at the end of an address part."""
        tail = slug.split("-")[-1]
        if not (tail.isascii() and tail.isdigit() and len(tail) < 19):
            raise NotFound("no such page")
        return int(tail)

    # search

    def search(self, query: str, district: str | None = None, attachments: bool = False, order: str = "relevance", most: int = LISTED) -> dict[str, DataFrame]:
        """Documents and minutes that hold the query, and how many more there are of each."""
        where = self.district(district)
        documents = tops.found(scopes.in_district(self.documents, where), query, self.attachments if attachments else None, order)
        held = self.agenda_items if where is None else joins.along(self.agenda_items, scopes.in_district(self.meetings, where).select("id"), ("agenda_items", "meetings"), "left_semi")
        minutes = tops.minutes_hits(held, self.meetings, query)
        shown = documents.limit(most).withColumn("excerpt", search.multi_excerpt("full_text", query))
        return {"documents": shown, "more_documents": aggregates.overflow(documents, most), "minutes": minutes.limit(most), "more_minutes": aggregates.overflow(minutes, most)}

    def search_tool(self, query: str, district: str | None = None) -> dict[str, DataFrame]:
        """The short answer for programs."""
        found = self.search(query, district, most=SHORT)
        return {"documents": found["documents"].select("id", "number", "title", "excerpt"), "minutes": found["minutes"].select("id", "meeting_id", "title", "minutes")}

    # documents

    def document_list(self, district: str | None, number: int = 1) -> DataFrame:
        rows = scopes.complete(scopes.in_district(self.documents, self.district(district)))
        shown = tops.page(rows, [F.col("number").desc_nulls_last(), F.col("id").desc()], number, PAGE)
        return shown.join(tops.latest_meeting(shown, self.agenda_items, self.meetings), shown["id"] == F.col("document_id"), "left")

    def document(self, slug: str) -> DataFrame:
        return scopes.by_id(self.documents, self.slug_id(slug))

    def document_json(self, number: str) -> DataFrame:
        return sinks.document_json(self.documents.where(F.col("number") == number), self.districts, self.agenda_items, self.meetings)

    def related(self, number: str) -> DataFrame:
        pairs = joins.related(self.documents)
        return self.documents.join(pairs.join(self.documents.where(F.col("number") == number).select("id"), "id").select(F.col("related_id").alias("id")), "id", "left_semi")

    def suggest_documents(self, term: str, district: str | None = None) -> DataFrame:
        rows = tops.suggestions(scopes.complete(scopes.in_district(self.documents, self.district(district))), term, SUGGESTED)
        return rows.select("id", "number", text.truncate("title", 120).alias("title"), search.excerpt("full_text", term, 50).alias("excerpt"))

    def suggest_items(self, term: str, district: str | None = None) -> DataFrame:
        rows = tops.minutes_hits(self.agenda_items, scopes.in_district(self.meetings, self.district(district)), term, SUGGESTED)
        return rows.select("id", "meeting_id", "title", dates.german_date("meetings_date").alias("date"), search.excerpt(text.strip_tags("minutes"), term, 50).alias("excerpt"))

    def archive(self, today, days: int = scopes.DEFAULT_DAYS, types: str = "", district: str | None = None, party: str | None = None, either: bool = False) -> DataFrame:
        """(id, number, title) of titled documents on agendas of the last days, of all the types, once each."""
        seen = scopes.in_last_days(self.meetings, scopes.clamp_days(days), today).select(F.col("id").alias("meeting_id"))
        dealt = self.agenda_items.join(seen, "meeting_id", "left_semi").select(F.col("document_id").alias("id"))
        rows = scopes.of_types(scopes.in_district(scopes.complete(self.documents), self.district(district)), types, either)
        rows = scopes.authored_by(rows, party) if party else rows
        return rows.join(dealt, "id", "left_semi").select("id", "number", "title").distinct()

    # meetings

    def meeting_list(self, today, number: int | None = None) -> DataFrame:
        """A page of titled meetings, latest first; by default the page of today."""
        rows = scopes.complete(self.meetings)
        number = number or tops.page_of_today(rows, today, PAGE).first()["page"]
        return tops.page(rows, [F.col("date").desc_nulls_last(), F.col("id").desc()], number, PAGE)

    def meeting(self, slug: str) -> dict[str, DataFrame]:
        own = scopes.by_id(self.meetings, self.slug_id(slug))
        items = self.agenda_items.join(own.select(F.col("id").alias("meeting_id")), "meeting_id", "left_semi")
        icon, colour = scopes.result_badge()
        return {"meeting": own, "items": tops.in_natural_order(items.withColumns({"icon": icon, "colour": colour})), "sheet": sinks.agenda_rows(items, self.documents, "")}

    # committees and parties

    def committee_list(self, district: str | None, today) -> DataFrame:
        rows = scopes.active(scopes.in_district(self.committees, self.district(district)))
        return joins.next_meetings(rows, self.meetings, today).orderBy(F.col("ord").asc_nulls_last(), F.col("name").asc_nulls_last(), "id")

    def committee(self, ident: int, today, months: int = 12) -> dict[str, DataFrame]:
        own = self.meetings.where(F.col("committee_id") == ident)
        out = {
            "averages": tops.recent_averages(self.committees.where(F.col("id") == ident), own, self.agenda_items),
            "stats": aggregates.meeting_stats(self.agenda_items.join(own.select(F.col("id").alias("meeting_id")), "meeting_id", "left_semi")),
            "documents": aggregates.filled(aggregates.documents_per_month(self.documents, self.agenda_items, scopes.in_last_months(own, months, today)), "n_appearances"),
            "words": aggregates.filled(aggregates.words_per_month(scopes.in_last_months(own, months, today), self.agenda_items), "words"),
        }
        if self.memberships is not None:
            out["members"] = tops.by_party_size(self.memberships.where(F.col("committee_id") == ident), self.members, self.parties)
        return out

    def party_list(self, district: str | None) -> DataFrame:
        where = self.district(district)
        return tops.parties_by_size(scopes.in_district(self.parties, where), scopes.in_district(self.members, where))

    def party(self, ident: int) -> DataFrame:
        return tops.members_in_order(scopes.active(self.members.where(F.col("party_id") == ident)))

    # calendar, map, statistics

    def calendar(self, day, today, district: str | None = None) -> DataFrame:
        where = self.district(district)
        districts = self.districts if where is None else self.districts.where(F.col("id") == where)
        return joins.calendar(self.meetings, districts, day, today)

    def map_markers(self, today, months: int = 3, most: int = 10) -> DataFrame:
        """Locations of documents of the last months with up to ten of the documents each."""
        dealt = joins.appearances(self.documents, self.agenda_items, scopes.in_last_months(self.meetings, months, today)).select("id", "number", "title").distinct()
        placed = self.document_locations.join(dealt.select(F.col("id").alias("document_id"), "number", "title"), "document_id")
        lists = aggregates.grouped_rows(placed, ["location_id"], ["document_id"], most, "documents")
        return self.locations.join(lists, self.locations["id"] == lists["location_id"]).drop("location_id")

    def map_centre(self, district: str) -> DataFrame:
        lat, lng = geo.centre()
        return self.districts.where(F.col("id") == self.district(district)).select(lat.alias("lat"), lng.alias("lng"))

    def location(self, ident: int, number: int = 1) -> DataFrame:
        linked = self.document_locations.where(F.col("location_id") == ident).select(F.col("document_id").alias("id"))
        return tops.page(self.documents.join(linked, "id", "left_semi").distinct(), [F.col("number").desc_nulls_last(), F.col("id").desc()], number, PAGE)

    def statistics(self, parties: list[str]) -> dict[str, DataFrame]:
        rows = scopes.current_legislation(self.documents, self.districts)
        kinds = {"all_documents": F.lit(True), "proposals": search.contains_term("kind", "Antrag"), "small_inquiries": F.col("kind").isin(scopes.SMALL_INQUIRIES), "large_inquiries": F.col("kind").isin(scopes.LARGE_INQUIRIES)}
        return {
            "total": rows.agg(F.count("*").alias("n")), "parties": aggregates.party_counts(rows, parties, kinds),
            "months": aggregates.filled(aggregates.documents_per_month(rows, self.agenda_items, self.meetings), "n_appearances"),
            "proposals": aggregates.filled(aggregates.documents_per_month(scopes.proposals(rows), self.agenda_items, self.meetings), "n_appearances"),
        }

    def front_page(self, district: str) -> dict[str, DataFrame]:
        where = self.district(district)
        return {
            "documents": tops.page(scopes.complete(scopes.in_district(self.documents, where)), [F.col("number").desc_nulls_last(), F.col("id").desc()], 1, NEWEST),
            "meetings": tops.page(scopes.complete(scopes.in_district(self.meetings, where)), [F.col("date").desc_nulls_last(), F.col("id").desc()], 1, NEWEST),
        }

    def years(self) -> DataFrame:
        return aggregates.known_years(self.meetings)

    def home(self) -> DataFrame:
        return self.documents.agg(F.count("*").alias("documents")).select(col("documents"))
