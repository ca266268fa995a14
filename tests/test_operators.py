import datetime

import pytest
from pyspark.sql import functions as F
from support import column

from plenum.operators import aggregates, joins, locate, scopes, sets, sync, tops
from plenum.schemas import SCHEMAS, empty

DAY = datetime.date


def frame(spark, name, rows):
    """A domain table of dicts; what a row leaves out is null."""
    names = [c.split()[0] for c in SCHEMAS[name].split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], SCHEMAS[name])


@pytest.fixture
def council(spark):
    committees = frame(spark, "committees", [{"id": 1, "name": "Bau"}, {"id": 2, "name": "leer"}, {"id": 3, "name": "ohne Zeiten"}])
    meetings = frame(spark, "meetings", [
        {"id": 1, "committee_id": 1, "date": DAY(2021, 1, 1), "start_sec": 0, "end_sec": 3600, "title": "a"}, {"id": 2, "committee_id": 1, "date": DAY(2021, 2, 1), "start_sec": 0, "end_sec": 7200, "title": "b"},
        {"id": 3, "committee_id": 1, "date": DAY(2021, 3, 1), "start_sec": 0, "end_sec": 60, "title": "c"}, {"id": 4, "committee_id": 3, "date": DAY(2021, 1, 1), "title": None},
    ])
    items = frame(spark, "agenda_items", [
        {"id": 1, "meeting_id": 1, "minutes": "x", "word_count": 3, "ext_id": 1, "document_id": 7}, {"id": 2, "meeting_id": 2, "minutes": "x", "word_count": 4, "ext_id": 2, "document_id": 7},
        {"id": 3, "meeting_id": 2, "word_count": 1}, {"id": 4, "meeting_id": 3, "word_count": 100}, {"id": 5, "meeting_id": 4, "minutes": "y", "word_count": 3},
    ])
    return committees, meetings, items


def test_recent_averages(spark, council):
    found = {r["committee_id"]: (r["word_count"], r["duration"]) for r in tops.recent_averages(*council).collect()}
    assert found == {1: (4, 5400), 2: (None, None), 3: (3, None)}
    assert tops.recent_averages(*council, limit=1).where("committee_id = 1").first()["word_count"] == 5


def test_semi_and_anti_joins(council):
    committees, meetings, items = council
    assert sorted(column(joins.with_minutes(meetings, items), "id")) == [1, 2, 4]
    assert sorted(column(joins.with_agenda(meetings, items), "id")) == [1, 2, 3]
    assert sorted(column(joins.without_logged_items(meetings, items), "id")) == [3, 4]


def test_series(spark, council):
    _, meetings, items = council
    series = aggregates.filled(aggregates.per_month(meetings.where("id in (1, 3)")))
    assert [tuple(r) for r in series.orderBy("month").collect()] == [(DAY(2021, 1, 1), 1), (DAY(2021, 2, 1), 0), (DAY(2021, 3, 1), 1)]
    assert aggregates.filled(aggregates.per_month(meetings.limit(0))).count() == 0
    assert aggregates.average_durations(meetings).where("committee_id = 3").first()["average_duration"] is None


def test_scopes(spark):
    documents = frame(spark, "documents", [
        {"id": 1, "number": "21-5000", "title": "Steg", "kind": "Antrag", "non_public": False, "district_id": 1}, {"id": 2, "number": "21-5000.1", "title": "Steg 2", "kind": "interfraktioneller ANTRAG", "non_public": False, "district_id": 1},
        {"id": 3, "number": "21-5000.1.1", "title": None, "kind": "Auskunftsersuchen", "non_public": False, "district_id": 1}, {"id": 4, "number": "21-50", "title": "100%", "non_public": None, "district_id": 1}, {"id": 5, "number": "21-5000.2", "title": "fern", "non_public": True, "district_id": 2},
    ])
    assert sorted(column(scopes.public(documents), "id")) == [1, 2, 3]
    assert sorted(column(scopes.proposals(documents), "id")) == [1, 2]
    assert column(scopes.state_inquiries(documents), "id") == [3]
    assert sorted(column(scopes.children(documents, "21-5000"), "id")) == [2, 3, 5]
    pairs = {}
    for r in joins.related(documents).collect():
        pairs.setdefault(r["id"], set()).add(r["related_id"])
    assert pairs[2] == {1, 3} and pairs[1] == {2, 3} and 4 not in pairs and 5 not in pairs
    assert column(tops.suggestions(documents, "100%"), "id") == [4]
    assert column(tops.suggestions(documents, "steg"), "id") == [1, 2]
    assert column(scopes.of_types(documents, "proposals,state_inquiries"), "id") == []
    assert sorted(column(scopes.of_types(documents, "proposals,state_inquiries", either=True), "id")) == [1, 2, 3]
    assert scopes.clamp_days(1000) == 365
    with pytest.raises(ValueError):
        scopes.clamp_days(-1)


def test_search(spark):
    documents = frame(spark, "documents", [{"id": 1, "number": "2", "title": "Haus", "full_text": "ein Haus"}, {"id": 2, "number": "3", "title": "Weg", "full_text": "Haus und Weg"}, {"id": 3, "number": "1", "title": None, "full_text": "Haus"}])
    attachments = frame(spark, "attachments", [{"id": 1, "attachable_type": "Document", "attachable_id": 2, "content": "Plan Haus"}, {"id": 2, "attachable_type": "Document", "attachable_id": 2, "content": None}, {"id": 3, "attachable_type": "Meeting", "attachable_id": 1, "content": "Plan"}])
    assert [(r["id"], r["rank"]) for r in tops.found(documents, "haus").collect()] == [(1, 1.4), (2, 0.4)]
    assert column(tops.found(documents, "haus weg"), "id") == [2]
    assert column(tops.found(documents, "haus", order="date"), "id") == [2, 1]
    assert tops.found(documents, " ?").count() == 0
    assert [(r["id"], r["rank"]) for r in tops.found(documents, "plan", attachments).collect()] == [(2, 0.2)]
    with pytest.raises(ValueError):
        tops.found(documents, "x", order="other")


def test_regular_members(spark):
    members = frame(spark, "members", [{"id": 1, "kind": "Mitglied", "party_id": 1, "name": "b", "inactive": False}, {"id": 2, "kind": None, "party_id": 1, "name": "a", "inactive": False}, {"id": 3, "kind": "zubenannte/r Bürger/in", "party_id": 1, "name": "0", "inactive": False}])
    assert column(scopes.regular(members), "id") == [1]
    assert column(tops.members_in_order(members), "id") == [2, 1, 3]


def test_roster(spark):
    stored = spark.createDataFrame([(1, 10, "a", False), (2, 10, "b", False), (3, 10, "c", True), (4, 20, "d", False)], "member_id long, committee_id long, role string, inactive boolean")
    shown = spark.createDataFrame([(1, 10, "chair"), (3, 10, "c"), (5, 10, "e")], "member_id long, committee_id long, role string")
    once = sync.roster(stored, shown, ["committee_id", "member_id"], ["committee_id"])
    expected = {(1, "chair", False), (2, "b", True), (3, "c", False), (4, "d", False), (5, "e", False)}
    assert {(r["member_id"], r["role"], r["inactive"]) for r in once.collect()} == expected
    assert {(r["member_id"], r["role"], r["inactive"]) for r in sync.roster(once, shown, ["committee_id", "member_id"], ["committee_id"]).collect()} == expected
    assert sync.roster(stored, shown.limit(0), ["committee_id", "member_id"], ["committee_id"]).collect() == stored.collect() or sync.roster(stored, shown.limit(0), ["committee_id", "member_id"], ["committee_id"]).exceptAll(stored).count() == 0


def test_upsert_and_marks(spark):
    stored = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, name string, n int")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "id int, name string")
    assert {tuple(r) for r in sync.upsert(stored, new, ["id"]).collect()} == {(1, "a", 5), (2, "x", 6), (3, "y", None)}
    assert {tuple(r) for r in sync.upsert(stored, new, ["id"], update=False).collect()} == {(1, "a", 5), (2, "b", 6), (3, "y", None)}
    known = spark.createDataFrame([(1, 7)], "district_id long, ext_id int")
    newest = spark.createDataFrame([(1, 9, 3), (2, 2, 2), (3, 2, 0)], "district_id long, newest int, oldest int")
    assert [tuple(r) for r in sync.missing_ids(known, newest).collect()] == [(1, 9), (1, 8), (3, 2), (3, 1)]
    names = spark.createDataFrame([("q",), ("p",), ("p",)], "name string")
    numbered = sync.next_ids(stored, names)
    ids = sorted(column(numbered, "id"))
    assert len(set(ids)) == 3 and ids[0] > 2 and ids == sorted(column(sync.next_ids(stored, names.repartition(3)), "id"))


def test_hard_sync_and_agenda(spark):
    stored = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "owner int, name string")
    shown = spark.createDataFrame([(1, "b"), (1, "n")], "owner int, name string")
    assert {tuple(r) for r in sync.replaced(stored, shown, ["owner"], ["name"]).collect()} == {(1, "b"), (1, "n"), (2, "c")}
    items = spark.createDataFrame([(1, "1", "old"), (1, "2", "keep"), (2, "1", "old")], "meeting_id long, number string, title string")
    page = spark.createDataFrame([(1, "1", "new"), (2, "9", "new"), (2, "", "none")], "meeting_id long, number string, title string")
    meetings = spark.createDataFrame([(1, DAY(2020, 1, 1)), (2, DAY(2030, 1, 1))], "id long, date date")
    found = sync.agenda(items, page, meetings, F.lit(DAY(2025, 1, 1)))
    assert {tuple(r) for r in found.collect()} == {(1, "1", "new"), (1, "2", "keep"), (2, "9", "new")}


def test_expired_party(spark):
    parties = spark.createDataFrame([(1, False), (2, False)], "id long, inactive boolean")
    members = spark.createDataFrame([(1, 1, False), (2, 2, False), (3, None, False)], "id long, party_id long, inactive boolean")
    a, b = sync.expire(parties, members, spark.createDataFrame([(1,)], "party_id long"))
    assert {tuple(r) for r in a.collect()} == {(1, True), (2, False)} and {tuple(r) for r in b.collect()} == {(1, 1, True), (2, 2, False), (3, None, False)}


STREETS = [
    {"name": "Testallee", "normalized_name": "testallee", "latitude": 53.5, "longitude": 10.0, "quarter": "Barmbek", "postal_code": "22305", "street_key": "k1", "districts": [4]},
    {"name": "Am Ring", "normalized_name": "am ring", "street_key": "k2", "districts": [3, 4]}, {"name": "Ohm", "normalized_name": "ohm", "districts": [4]}, {"name": "Hamburg", "normalized_name": "hamburg", "districts": [4]},
]


def test_street_matches(spark):
    streets = frame(spark, "streets", STREETS)
    districts = frame(spark, "districts", [{"id": 1, "name": "Hamburg-Nord"}])
    names = locate.dictionary(streets, scopes.blocked_names(districts))
    assert sorted(column(names, "name")) == ["am ring", "testallee"]
    texts = spark.createDataFrame([(1, "In der TESTALLEE und am Ring, Testallee."), (2, "Testalleebar"), (3, None), (4, "Ohm Hamburg")], "id long, text string")
    found = {r["id"]: r["names"] for r in locate.extracted(texts, names).collect()}
    assert found == {1: ["testallee", "am ring"], 2: [], 3: [], 4: []}
    entities = spark.createDataFrame([(2, [("Großer Platz!", "LOCATION", 0.5), ("Nein", "LOCATION", 0.1), ("Wer", "PERSON", 0.9)])], "id long, entities array<struct<text: string, tag: string, score: double>>")
    assert {r["id"]: r["names"] for r in locate.extracted(texts, names, entities).collect()}[2] == ["Großer Platz"]


def test_cascade(spark):
    streets = frame(spark, "streets", STREETS)
    districts = frame(spark, "districts", [{"id": 1, "name": "Hamburg-Nord", "ne_lat": 54.0, "ne_lng": 11.0, "sw_lat": 53.0, "sw_lng": 9.0}])
    stored = frame(spark, "locations", [{"id": 1, "district_id": 1, "name": "Park", "extracted_name": "Park", "normalized_name": "park"}])
    answer = '{"candidates": [{"place_id": "p", "name": "Platz", "geometry": {"location": {"lat": 53.5, "lng": 10.0}}, "types": ["park"]}, {"place_id": "far", "name": "Fern", "geometry": {"location": {"lat": 1.0, "lng": 1.0}}, "types": ["park"]}, {"place_id": "shop", "name": "Laden", "geometry": {"location": {"lat": 53.5, "lng": 10.0}}, "types": ["store"]}]}'
    cache = spark.createDataFrame([(1, "platz", answer), (1, "park", answer), (1, "testallee", answer)], "district_id long, query string, locations string")
    wanted = spark.createDataFrame([(1, n) for n in ("Park", "Testallee", "Platz", "hamburg", "Nirgends")], "district_id long, name string")
    found = {(r["extracted_name"], r["stage"], r["name"], r["place_id"]) for r in locate.resolved(wanted, stored, streets, cache, districts).collect()}
    assert found == {("Park", "stored", "Park", None), ("Testallee", "gazetteer", "Testallee", "gazetteer:k1"), ("Platz", "geocoder", "Platz", "p")}


def test_local_areas(spark):
    names = spark.createDataFrame([(1, "Lokstedt"), (1, "Testallee"), (2, "Lokstedt")], "document_id long, name string")
    handled = spark.createDataFrame([(1, "Regionalausschuss Lokstedt"), (2, "Bauausschuss Lokstedt")], "document_id long, committee string")
    assert {tuple(r) for r in locate.without_local_areas(names, handled).collect()} == {(1, "Testallee"), (2, "Lokstedt")}


def test_sets(spark):
    a, b = spark.createDataFrame([(1, None), (2, "x")], "id int, name string"), spark.createDataFrame([(2, "x"), (3, "y")], "id int, name string")
    assert {tuple(r) for r in sets.either(a, b).collect()} == {(1, None), (2, "x"), (3, "y")}
    assert [tuple(r) for r in sets.minus(a, b, ["id", "name"]).collect()] == [(1, None)]
    assert empty(spark, "meetings").count() == 0


def test_natural_order(spark):
    items = frame(spark, "agenda_items", [{"id": k, "number": n} for k, n in enumerate(["Ö 10", "Ö 9", "Ö 6.1.1", "Ö 6.1"])])
    assert column(tops.in_natural_order(items), "number") == ["Ö 6.1", "Ö 6.1.1", "Ö 9", "Ö 10"]


def test_known_place_of_the_geocoder(spark):
    districts = spark.createDataFrame([(1, "Altona", 2.0, 2.0, 1.0, 1.0)], "id long, name string, ne_lat double, ne_lng double, sw_lat double, sw_lng double")
    answer = '{"candidates": [{"place_id": "p1", "name": "x", "geometry": {"location": {"lat": 9.0, "lng": 9.0}}, "types": ["store"]}, {"place_id": "p2", "name": "y", "geometry": {"location": {"lat": 1.5, "lng": 1.5}}, "types": ["park"]}]}'
    cache = spark.createDataFrame([(1, "am see", answer)], "district_id long, query string, locations string")
    stored = spark.createDataFrame([(1, "Alt", "alt", 5.0, 6.0, "p1", "f"), (2, "Fern", "fern", 7.0, 8.0, "p2", "g")], "district_id long, name string, normalized_name string, latitude double, longitude double, place_id string, formatted_address string")
    wanted = spark.createDataFrame([(1, "Am See")], "district_id long, name string")
    found = {r["place_id"]: (r["name"], r["latitude"], r["extracted_name"]) for r in locate.from_geocoder(wanted, cache, districts, stored).collect()}
    assert found == {"p1": ("Alt", 5.0, "Am See"), "p2": ("y", 1.5, "Am See")}
    assert {r["place_id"] for r in locate.from_geocoder(wanted, cache, districts).collect()} == {"p2"}


def test_street_runs(spark):
    names = spark.createDataFrame([("am ring",), ("ring",), ("am ring nord",), ("weg",)], "name string")
    texts = spark.createDataFrame([(1, "Der Weg Am Ring, am ring"), (2, "wege am ringe"), (3, None), (4, "")], "id long, text string")
    assert sorted(tuple(r) for r in locate.street_matches(texts, names).collect()) == [(1, "am ring", 2), (1, "ring", 3), (1, "weg", 1)]
    assert locate.street_matches(texts, names.limit(0)).count() == 0


def test_natural_key_of_huge_numbers(spark):
    rows = spark.createDataFrame([("Ö 99999999999",), ("Ö 9",), ("Ö 999999999999999999999",), (None,)], "number string").withColumn("id", F.lit(1))
    assert [r["number"] for r in tops.in_natural_order(rows).collect()][1:] == ["Ö 999999999999999999999", "Ö 9", "Ö 99999999999"]
