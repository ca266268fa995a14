"""Named filters on the domain tables. Each takes a DataFrame and gives one, for df.transform(...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions import dates, geo, search, text
from plenum.functions.text import col

#: Kinds of papers and of members.
SMALL_INQUIRIES = ["Kleine Anfrage nach § 24 BezVG", "Anfrage gem. § 24 BezVG (Kleine Anfrage)", "Kleine Anfrage öffentlich", "Kleine Anfrage gem. § 24 BezVG"]
LARGE_INQUIRIES = ["Große Anfrage nach § 24 BezVG", "Anfrage gem. § 24 BezVG (Große Anfrage)", "Große Anfrage öffentlich", "Große Anfrage gem. § 24 BezVG"]
STATE_INQUIRIES = ["Anfrage nach § 27 BezVG", "Anfrage gem. § 27 BezVG", "Auskunftsersuchen"]
CO_OPTED = ["zubenannte/r Bürger/in", "Zubenannte/r Bürger/in"]
#: Names that are no place, and types of places that are.
BLOCKED = ["deutschland", "norderstedt", "hamburg", "hamburgs", "straße", "hamburg nord", "hamburg mitte"]
PLACE_TYPES = ["park", "route", "political", "sublocality"]
#: Decisions with their icon and colour.
DECISIONS = {
    "zur Kenntnis genommen": ("dot-circle", "secondary"),
    "ungeändert beschlossen": ("check-circle", "success"), "beschlossen": ("check-circle", "success"), "ungeändert beschlossen / überwiesen": ("check-circle", "success"),
    "geändert beschlossen": ("check-circle", "info"), "geändert beschlossen / überwiesen": ("check-circle", "info"),
    "vertagt": ("arrow-alt-circle-right", "warning"), "an Ausschuss überwiesen": ("arrow-alt-circle-right", "warning"), "an Fachausschuss verwiesen": ("arrow-alt-circle-right", "warning"), "vertagt / verbleibt": ("arrow-alt-circle-right", "warning"),
    "zurückgestellt": ("arrow-alt-circle-left", "warning"), "abgelehnt": ("times-circle", "danger"),
    "zurückgezogen": ("arrow-alt-circle-down", "secondary"), "zurückgezogen / erledigt": ("arrow-alt-circle-down", "secondary"),
}
DEFAULT_DAYS, MOST_DAYS = 30, 365


def public(documents: DataFrame) -> DataFrame:
    """What every query on documents sees: not flagged, and not unknown, as non-public."""
    return documents.where(~F.col("non_public"))


def complete(df: DataFrame) -> DataFrame:
    return df.where(F.col("title").isNotNull())


def logged(items: DataFrame) -> DataFrame:
    return items.where(F.col("ext_id").isNotNull())


def with_minutes_text(items: DataFrame) -> DataFrame:
    return items.where(F.col("minutes").isNotNull())


def has_protocol(items: DataFrame) -> DataFrame:
    """Minutes or result hold more than markup and blanks."""
    shown = lambda c: F.length(F.trim(F.regexp_replace(F.coalesce(text.strip_tags(c), F.lit("")), r"[\s ]+", ""))) > 0
    return items.where(shown("minutes") | shown("result"))


def incomplete(items: DataFrame, meetings: DataFrame, today) -> DataFrame:
    """Logged items without minutes and result, of meetings 270 to 30 days ago."""
    window = meetings.where(F.col("date").between(F.date_sub(col(today), 270), F.date_sub(col(today), 30))).select(F.col("id").alias("meeting_id"))
    return logged(items).where(F.col("minutes").isNull() & F.col("result").isNull()).join(window, "meeting_id", "left_semi")


def proposals(documents: DataFrame) -> DataFrame:
    return documents.where(search.contains_term("kind", "Antrag"))


def small_inquiries(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("kind").isin(SMALL_INQUIRIES))


def large_inquiries(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("kind").isin(LARGE_INQUIRIES))


def state_inquiries(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("kind").isin(STATE_INQUIRIES))


def by_author(name: str) -> Column:
    return search.contains_term("title", name) | search.contains_term("author", name)


def authored_by(documents: DataFrame, name: str) -> DataFrame:
    return documents.where(by_author(name))


def since_number(documents: DataFrame, number) -> DataFrame:
    return documents.where(F.col("number") >= col(number))


def current_legislation(documents: DataFrame, districts: DataFrame) -> DataFrame:
    """Documents from their district's first number of the legislation on."""
    first = districts.select(F.col("id").alias("district_id"), "first_number")
    return documents.join(first, "district_id").where(F.col("number") >= F.col("first_number")).drop("first_number")


def children(documents: DataFrame, number: str) -> DataFrame:
    return documents.where(F.startswith(F.col("number"), F.lit(f"{number}.")))


def in_date_range(rows: DataFrame, first, last, date: str = "date") -> DataFrame:
    return rows.where(F.col(date).between(col(first), col(last)))


def in_last_months(rows: DataFrame, n: int, today) -> DataFrame:
    """From n + 1 months ago to the end of the previous month, whole months."""
    return in_date_range(rows, *dates.months_back(today, n))


def in_last_days(rows: DataFrame, n: int, today) -> DataFrame:
    return in_date_range(rows, F.date_sub(col(today), n), today)


def in_month(meetings: DataFrame, day) -> DataFrame:
    return in_date_range(meetings, dates.month(day), F.last_day(col(day)))


def in_future(meetings: DataFrame, today) -> DataFrame:
    return meetings.where(F.col("date") >= col(today))


def recent(meetings: DataFrame, today) -> DataFrame:
    return in_date_range(meetings, F.date_sub(col(today), 7), F.date_add(col(today), 7))


def with_duration(meetings: DataFrame) -> DataFrame:
    return meetings.where(F.col("start_sec").isNotNull() & F.col("end_sec").isNotNull())


def active(df: DataFrame) -> DataFrame:
    return df.where(~F.col("inactive"))


def open_to_public(committees: DataFrame) -> DataFrame:
    return committees.where(F.col("public"))


def co_opted(members: DataFrame) -> DataFrame:
    return members.where(F.col("kind").isin(CO_OPTED))


def regular(members: DataFrame) -> DataFrame:
    """Members of another kind; an unknown kind is left out, as NOT IN does."""
    return members.where(~F.col("kind").isin(CO_OPTED))


def not_extracted(documents: DataFrame, most: int = 5000) -> DataFrame:
    """The next batch of documents without extracted locations, in order of id."""
    return documents.where(F.col("locations_extracted_at").isNull()).orderBy("id").limit(most)


def in_district(df: DataFrame, district: int | None) -> DataFrame:
    """Rows of a district; no district means all."""
    return df if district is None else df.where(F.col("district_id") == district)


def of_city_district(streets: DataFrame, number) -> DataFrame:
    return streets.where(F.array_contains("districts", col(number)))


def inside(points: DataFrame) -> DataFrame:
    """Points that are not outside their box."""
    return points.where(~geo.out_of_bounds("latitude", "longitude"))


def valid_places(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.arrays_overlap("types", F.array(*[F.lit(t) for t in PLACE_TYPES])))


def blocked_names(districts: DataFrame) -> DataFrame:
    """(normalized_name): the fixed names, and each district's name alone and after "bezirk"."""
    fixed = districts.sparkSession.createDataFrame([(n,) for n in BLOCKED], "normalized_name string")
    own = districts.select(F.explode(F.array(F.lower("name"), F.concat(F.lit("bezirk "), F.lower("name")))).alias("normalized_name"))
    return fixed.union(own).distinct()


def not_blocked(names: DataFrame, districts: DataFrame, column: str = "name") -> DataFrame:
    """Rows whose normalised name is not blocked."""
    stop = blocked_names(districts)
    return names.join(stop, text.normalize_location(column) == stop["normalized_name"], "left_anti")


def location_entities(entities, threshold: float = 0.4) -> Column:
    """Cleaned texts of entities (text, tag, score) that are locations of at least that score."""
    good = F.filter(col(entities), lambda e: (e["tag"] == "LOCATION") & (e["score"] >= threshold) & (F.length(F.trim(e["text"])) > 0))
    return F.array_distinct(F.transform(good, lambda e: text.clean_entity(e["text"])))


#: The scopes that an archive request may name.
TYPES = {"proposals": proposals, "small_inquiries": small_inquiries, "large_inquiries": large_inquiries, "state_inquiries": state_inquiries}


def of_types(documents: DataFrame, types: str, either: bool = False) -> DataFrame:
    """Documents of all the named types (comma-separated, unknown ones ignored), or with `either` of any."""
    named = [t for t in types.split(",") if t in TYPES]
    if not either or not named:
        return reduce(lambda df, t: TYPES[t](df), named, documents)
    conditions = {"proposals": search.contains_term("kind", "Antrag"), "small_inquiries": F.col("kind").isin(SMALL_INQUIRIES), "large_inquiries": F.col("kind").isin(LARGE_INQUIRIES), "state_inquiries": F.col("kind").isin(STATE_INQUIRIES)}
    return documents.where(reduce(lambda a, b: a | b, [conditions[t] for t in named]))


def clamp_days(days: int) -> int:
    if days < 0:
        raise ValueError("days must not be negative")
    return min(days, MOST_DAYS)


def result_badge(decision="decision") -> tuple[Column, Column]:
    """(icon, colour) of a decision, null for others."""
    pick = lambda k: F.try_element_at(F.create_map(*[F.lit(x) for d, v in DECISIONS.items() for x in (d, v[k])]), col(decision))
    return pick(0), pick(1)


def needs_update(documents: DataFrame, now) -> DataFrame:
    """Documents without a title, or last changed over four hours ago."""
    return documents.where(F.coalesce(F.length(F.trim("title")) == 0, F.lit(True)) | (F.col("updated_at") < F.timestamp_add("HOUR", F.lit(-4), col(now))))


def by_property(events: DataFrame, key: str, value: str, column: str = "properties") -> DataFrame:
    """Events whose JSON properties hold the value under the key."""
    return events.where(F.get_json_object(column, f"$.{key}") == value)


def by_id(df: DataFrame, value, key: str = "id") -> DataFrame:
    """Point look-up: at most one row."""
    return df.where(F.col(key) == value).limit(1)


def from_register(locations: DataFrame) -> DataFrame:
    """Locations that the street register gave, by the prefix of their place id."""
    return locations.where(F.col("place_id").like("gazetteer:%"))
