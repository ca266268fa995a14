"""The register of streets, as GML that a paged service returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.functions import geo, text
from plenum.functions.text import col

ROW_TAG, PAGE_SIZE = "Strassen", 2000
SCHEMA = """strassenname string, postleitzahl string, strassenschluessel array<string>, ortsteilname array<string>,
position struct<Point: struct<pos: string>>"""


def read(spark: SparkSession, path: str) -> DataFrame:
    """The register's rows in landed pages, as the table streets. Streets without a name are left out."""
    raw = spark.read.format("xml").option("rowTag", ROW_TAG).option("ignoreNamespace", "true").schema(SCHEMA).load(path)
    return rows(raw)


def rows(raw: DataFrame) -> DataFrame:
    """Parsed features as streets: normalised name, point, first key, and the districts of all keys."""
    keys = F.filter(F.transform(F.coalesce("strassenschluessel", F.array().cast("array<string>")), text.squish), lambda k: F.length(k) > 0)
    lat, lng = geo.ordered_point("position.Point.pos")
    name = F.when(F.length(text.squish("strassenname")) > 0, text.squish("strassenname"))
    quarter = F.split(text.squish(F.get(col("ortsteilname"), F.lit(0))), ",")[0]
    return raw.where(name.isNotNull()).select(
        name.alias("name"), text.normalize_street(name).alias("normalized_name"), lat.alias("latitude"), lng.alias("longitude"), quarter.alias("quarter"),
        F.nullif(text.squish("postleitzahl"), F.lit("")).alias("postal_code"), F.get(keys, F.lit(0)).alias("street_key"), geo.key_districts(keys).alias("districts"),
    )


def page_urls(spark: SparkSession, base: str, total: int) -> DataFrame:
    """(start, url) of every page of a service of that many streets, one row a request."""
    start = (F.col("id") * PAGE_SIZE).cast("int")
    query = text.query_string({"service": "WFS", "version": "2.0.0", "request": "GetFeature", "typeName": "dog:Strassen", "srsName": "EPSG:4326", "count": PAGE_SIZE, "startIndex": start.cast("string")})
    return spark.range(-(-total // PAGE_SIZE)).select(start.alias("start"), F.concat(F.lit(base + "?"), query).alias("url"))
