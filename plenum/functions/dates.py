"""Column functions on dates and times of day; "today" is always a parameter, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenum.functions.text import col, squish


def month(c) -> Column:
    """The first day of a date's month, as a date."""
    return F.trunc(col(c), "MM").cast("date")


def months_back(today, n: int) -> tuple[Column, Column]:
    """First and last day of the window from n + 1 months ago to the previous month, whole months."""
    return F.trunc(F.add_months(col(today), -(n + 1)), "MM"), F.last_day(F.add_months(col(today), -1))


def split_times(c) -> tuple[Column, Column]:
    """"18:00 - 19:15" as seconds of the day; one time alone is start and end."""
    parts = F.split(col(c), "-")
    return seconds(squish(parts[0])), seconds(squish(F.element_at(parts, -1)))


def seconds(c) -> Column:
    """"18:05" or "18:05:30" as seconds of the day; anything else is null."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(col(c), r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$", k), F.lit("")), F.lit("0")).cast("int")
    return F.when(col(c).rlike(r"^\d{1,2}:\d{2}(:\d{2})?$"), part(1) * 3600 + part(2) * 60 + part(3))


def duration(start="start_sec", end="end_sec") -> Column:
    return col(end) - col(start)


def starts_at(date="date", start="start_sec") -> Column:
    """Date and time of day as a timestamp without zone."""
    return F.timestamp_add("SECOND", col(start), col(date).cast("timestamp_ntz"))


def ends_at(date="date", start="start_sec", end="end_sec", average="average_duration") -> Column:
    """End as recorded, else start and the committee's average, else start and four hours."""
    late = F.when(col(end).isNotNull(), col(end)).otherwise(col(start) + F.coalesce(col(average), F.lit(4 * 3600)))
    return F.timestamp_add("SECOND", late, col(date).cast("timestamp_ntz"))


def parse_german_date(c) -> Column:
    """"Montag, 01.02.2021" as a date; null where it is none."""
    text = F.trim(F.element_at(F.split(col(c), ","), -1))
    return F.try_to_date(text, "dd.MM.yyyy") if hasattr(F, "try_to_date") else F.when(text.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), F.try_to_timestamp(text, F.lit("dd.MM.yyyy")).cast("date"))


def german_date(c) -> Column:
    return F.date_format(col(c), "dd.MM.yyyy")


def safe_month(year, month_, fallback, least_year, most_year) -> Column:
    """The month of a request, the fallback's where it is no date, with the year clamped to known ones."""
    made = F.make_date(F.greatest(F.least(col(year), col(most_year)), col(least_year)), col(month_), F.lit(1))
    return F.when(col(month_).between(1, 12) & col(year).isNotNull(), made).otherwise(month(fallback))
