"""What goes out: JSON answers, agendas as CSV, the sitemap as XML, structured data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions import dates, text
from plenum.functions.text import col
from plenum.operators import scopes


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as JSON, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def agenda_rows(items: DataFrame, documents: DataFrame, base: str) -> DataFrame:
    """An agenda for a sheet: number, title, document number and its address."""
    papers = documents.select(F.col("id").alias("document_id"), F.col("number").alias("document"), F.concat(F.lit(f"{base}/documents/"), text.slug("title", "id")).alias("url"))
    return items.join(papers, "document_id", "left").select("meeting_id", "number", "title", "document", "url")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").csv(path)


#: Pages of their own in the sitemap (path, priority, changefreq); other pages change weekly.
PAGES = [("/home", 0.9, "daily"), ("/contact_us", 0.5, "weekly")]


def meeting_slug() -> Column:
    """A meeting's address part: its day, its title and its id."""
    return F.concat_ws("-", text.parameterize(dates.german_date("date")), text.slug("title", "id"))


def sitemap(base: str, districts: DataFrame, documents: DataFrame, meetings: DataFrame) -> DataFrame:
    """(loc, priority, changefreq): the fixed pages, titled documents and meetings with their minutes' pages below their district, districts."""
    named = districts.select(F.col("id").alias("district_id"), text.parameterize("name").alias("district"))
    url = lambda *rest: F.concat(F.lit(f"{base}/"), "district", *[F.lit(x) if x.startswith("/") else F.col(x) for x in rest]).alias("loc")
    rank = lambda p: (F.lit(p).alias("priority"), F.lit("weekly").alias("changefreq"))
    papers = scopes.complete(documents).select("district_id", text.slug("title", "id").alias("name")).join(F.broadcast(named), "district_id")
    held = scopes.complete(meetings).select("district_id", meeting_slug().alias("name")).join(F.broadcast(named), "district_id")
    pages = F.explode(F.array(F.struct(F.lit("").alias("tail")), F.struct(F.lit("/protokoll").alias("tail")))).alias("p")
    parts = [
        districts.sparkSession.createDataFrame([(base + path, p, f) for path, p, f in PAGES], "loc string, priority double, changefreq string"),
        papers.select(url("/documents/", "name"), *rank(0.9)),
        held.select("district", "name", pages).select("district", "name", F.col("p.tail").alias("tail")).select(url("/meetings/", "name", "tail"), *rank(0.5)),
        named.select(url(), *rank(0.3)),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_sitemap(rows: DataFrame, path: str) -> None:
    rows.write.format("xml").option("rowTag", "url").option("rootTag", 'urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"').save(path)


def article(documents: DataFrame, districts: DataFrame, base: str) -> DataFrame:
    """(id, json): documents as articles for search engines."""
    own = districts.select(F.col("id").alias("district_id"), F.col("name").alias("district"))
    field = lambda **x: F.struct(*[v.alias(k) for k, v in x.items()])
    json: Column = F.to_json(F.struct(
        F.lit("http://schema.org").alias("@context"), F.lit("Article").alias("@type"),
        F.struct(F.lit("WebPage").alias("@type"), F.concat(F.lit(f"{base}/documents/"), text.slug("title", "id")).alias("@id")).alias("mainEntityOfPage"),
        text.squish("title").alias("headline"), F.coalesce(text.squish("full_text"), F.lit("")).alias("articleBody"), F.col("district").alias("articleSection"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datePublished"), F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("dateModified"),
        field(name=F.concat(F.lit("Bezirksversammlung "), F.col("district"))).alias("publisher"), F.lit("True").alias("isAccessibleForFree"),
        F.coalesce(text.truncate(text.squish(text.strip_tags("content")), 200), F.lit("")).alias("description"),
    ))
    return documents.join(own, "district_id").select("id", json.alias("json"))


def event(meetings: DataFrame, committees: DataFrame, agendas: DataFrame) -> DataFrame:
    """(id, json): meetings as events, with their agenda as description."""
    own = committees.select(F.col("id").alias("committee_id"), F.col("name").alias("committee"), "average_duration")
    rows = meetings.join(own, "committee_id", "left").join(agendas.select(F.col("meeting_id").alias("id"), "agenda"), "id", "left")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    place = F.struct(F.lit("Place").alias("@type"), F.col("room").alias("name"), F.struct(F.lit("PostalAddress").alias("@type"), F.col("location").alias("streetAddress"), F.lit("Hamburg").alias("addressLocality"), F.lit("DE").alias("addressCountry")).alias("address"))
    json = F.to_json(F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), F.col("title").alias("name"), stamp(dates.starts_at()).alias("startDate"), stamp(dates.ends_at()).alias("endDate"),
        F.lit("https://schema.org/OfflineEventAttendanceMode").alias("eventAttendanceMode"), F.lit("https://schema.org/EventScheduled").alias("eventStatus"), place.alias("location"),
        F.coalesce("agenda", F.lit("")).alias("description"), F.struct(F.lit("Offer").alias("@type"), F.lit(0).alias("price")).alias("offers"),
        F.struct(F.lit("Organization").alias("@type"), F.col("committee").alias("name")).alias("performer"),
    ))
    return rows.select("id", json.alias("json"))


def document_json(documents: DataFrame, districts: DataFrame, items: DataFrame, meetings: DataFrame) -> DataFrame:
    """(id, json): documents whole, with district and meetings; a document's meetings are few."""
    met = items.select("meeting_id", "document_id").join(meetings.select(F.col("id").alias("meeting_id"), "title", "date", "start_sec", "end_sec"), "meeting_id")
    lists = met.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("meeting_id").alias("id"), "title", "date", "start_sec", "end_sec"))).alias("meetings"))
    own = districts.select(F.col("id").alias("district_id"), F.col("name").alias("district"))
    rows = documents.join(own, "district_id", "left").join(lists, "id", "left")
    shown = lambda c: text.strip_tags(c).alias(c)
    none = F.array().cast(lists.schema["meetings"].dataType)
    return rows.select("id", F.to_json(F.struct("id", "number", "title", "kind", "author", shown("content"), shown("resolution"), shown("attached"), "created_at", "updated_at", "district", F.coalesce("meetings", none).alias("meetings")), {"ignoreNullFields": "false"}).alias("json"))


def catalog(spark) -> DataFrame:
    """(name, kind) of the session's tables and views, the nearest to a database's own catalog."""
    rows = [(t.name, t.tableType) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, kind string").select(col("name"), col("kind"))
