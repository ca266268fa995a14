"""Schemas of the tables, written out as DDL; nothing is inferred."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "districts": "id bigint, name string, base_url string, first_number string, oldest_doc_id int, oldest_meeting_date date, ord int, ne_lat double, ne_lng double, sw_lat double, sw_lng double",
    "committees": "id bigint, district_id bigint, ext_id int, ext_type string, name string, ord int, public boolean, inactive boolean, average_duration int, average_word_count int",
    "meetings": "id bigint, district_id bigint, committee_id bigint, ext_id int, date date, start_sec int, end_sec int, title string, room string, location string, note string",
    "agenda_items": "id bigint, meeting_id bigint, document_id bigint, ext_id int, number string, title string, decision string, minutes string, result string, word_count int",
    "documents": "id bigint, district_id bigint, ext_id int, number string, title string, kind string, author string, content string, resolution string, attached string, full_text string, extracted_locations array<string>, locations_extracted_at timestamp_ntz, non_public boolean, noindex boolean, created_at timestamp_ntz, updated_at timestamp_ntz",
    "attachments": "id bigint, attachable_type string, attachable_id bigint, district_id bigint, name string, content string",
    "parties": "id bigint, district_id bigint, ext_id int, name string, inactive boolean",
    "members": "id bigint, district_id bigint, party_id bigint, ext_id int, name string, kind string, inactive boolean",
    "memberships": "id bigint, committee_id bigint, member_id bigint, role string, inactive boolean",
    "attendances": "id bigint, meeting_id bigint, member_id bigint, name string, party_hint string, present boolean, role string, substitute boolean",
    "locations": "id bigint, district_id bigint, name string, extracted_name string, normalized_name string, latitude double, longitude double, place_id string, formatted_address string",
    "document_locations": "document_id bigint, location_id bigint",
    "streets": "name string, normalized_name string, latitude double, longitude double, quarter string, postal_code string, street_key string, districts array<int>",
    "places": "district_id bigint, query string, locations string",
    "visits": "id bigint, visitor string, started_at timestamp_ntz, landing_page string",
    "events": "id bigint, visit_id bigint, name string, properties string, time timestamp_ntz",
}

#: Declared join paths: (table, table) -> pairs of columns. The polymorphic owner of an attachment is tagged.
PATHS = {
    ("agenda_items", "meetings"): [("meeting_id", "id")],
    ("agenda_items", "documents"): [("document_id", "id")],
    ("meetings", "committees"): [("committee_id", "id")],
    ("meetings", "districts"): [("district_id", "id")],
    ("documents", "districts"): [("district_id", "id")],
    ("committees", "districts"): [("district_id", "id")],
    ("memberships", "committees"): [("committee_id", "id")],
    ("memberships", "members"): [("member_id", "id")],
    ("members", "parties"): [("party_id", "id")],
    ("parties", "districts"): [("district_id", "id")],
    ("attendances", "meetings"): [("meeting_id", "id")],
    ("locations", "districts"): [("district_id", "id")],
    ("document_locations", "documents"): [("document_id", "id")],
    ("document_locations", "locations"): [("location_id", "id")],
    ("places", "districts"): [("district_id", "id")],
}


def empty(spark, name: str):
    """An empty table of that name."""
    return spark.createDataFrame([], SCHEMAS[name])
