"""Locations in texts: street names by dictionary, and the cascade that resolves a name to places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.functions import geo, text
from plenum.operators import scopes

LEAST_LENGTH, LOCAL = 4, "Regionalausschuss"
#: Bytes of a dictionary that are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 8 << 20


def dictionary(streets: DataFrame, blocked: DataFrame) -> DataFrame:
    """(name): distinct normalised street names that are long enough and not blocked."""
    names = streets.select(F.col("normalized_name").alias("name")).where(F.length("name") >= LEAST_LENGTH).distinct()
    return names.join(blocked.select(F.col("normalized_name").alias("name")), "name", "left_anti")


def street_matches(texts: DataFrame, names: DataFrame, key: str = "id", content: str = "text") -> DataFrame:
    """(id, name, place): dictionary names among the runs of words of each text, once each, with the first place.

    A text gives one row a word, with the run of words from there that the longest name needs; it meets the
    names by their first word and stays where the run begins with the name. The dictionary is broadcast if it
    is small, as a check of its size in bytes tells; a larger one is joined by shuffle.
    """
    about = names.agg(F.sum(F.octet_length("name") + 32).alias("bytes"), F.max(F.size(F.split("name", " "))).alias("most")).first()
    if about["bytes"] is None:
        return texts.select(key, F.lit("").alias("name"), F.lit(0).alias("place")).limit(0)
    words = texts.select(key, text.tokens(content).alias("_words"))
    run = F.transform("_words", lambda w, at: F.struct(w.alias("first"), F.concat(F.array_join(F.slice("_words", at + 1, about["most"]), " "), F.lit(" ")).alias("run")))
    runs = words.select(key, F.posexplode(run).alias("place", "w")).select(key, "place", "w.first", "w.run")
    side = names.select("name", F.split("name", " ")[0].alias("first"))
    side = F.broadcast(side) if about["bytes"] <= BROADCAST_BYTES else side
    hits = runs.join(side, "first").where(F.startswith("run", F.concat("name", F.lit(" "))))
    return hits.groupBy(key, "name").agg(F.min("place").alias("place")).select(key, "name", "place")


def extracted(texts: DataFrame, names: DataFrame, entities: DataFrame | None = None, key: str = "id", content: str = "text") -> DataFrame:
    """(id, names): street names in order of occurrence, then cleaned entities (id, entities), once each."""
    found = street_matches(texts, names, key, content).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("streets"))
    rows = texts.select(key).join(found, key, "left")
    none = F.array().cast("array<string>")
    if entities is None:
        return rows.select(key, F.coalesce("streets", none).alias("names"))
    own = entities.select(key, scopes.location_entities("entities").alias("others"))
    return rows.join(own, key, "left").select(key, F.array_union(F.coalesce("streets", none), F.coalesce("others", none)).alias("names"))


def without_local_areas(names: DataFrame, handled: DataFrame) -> DataFrame:
    """names(document_id, name, ...) without those that name the area of a local committee that dealt with the document.

    handled(document_id, committee): names of the document's committees. Compared are ASCII forms in lower case.
    """
    areas = handled.where(F.contains("committee", F.lit(LOCAL))).select("document_id", text.area_key(F.trim(F.regexp_replace("committee", LOCAL, ""))).alias("_area")).distinct()
    keyed = names.withColumn("_area", text.area_key("name"))
    return keyed.join(areas, ["document_id", "_area"], "left_anti").drop("_area")


def from_gazetteer(wanted: DataFrame, streets: DataFrame, districts: DataFrame) -> DataFrame:
    """wanted(district_id, name) -> locations by the register: an equal normalised name in the district's number."""
    numbered = districts.select(F.col("id").alias("district_id"), geo.district_number("name").alias("number")).where("number is not null")
    keyed = wanted.withColumn("normalized", text.normalize_street("name")).join(numbered, "district_id")
    rows = streets.withColumnRenamed("name", "street").withColumnRenamed("normalized_name", "normalized")
    found = keyed.join(rows, "normalized").where(F.array_contains("districts", F.col("number")))
    return found.select(
        "district_id", F.col("name").alias("extracted_name"), F.col("street").alias("name"), text.normalize_location("name").alias("normalized_name"), "latitude", "longitude",
        F.concat(F.lit("gazetteer:"), "street_key").alias("place_id"), text.address("street", "postal_code", "quarter").alias("formatted_address"),
    ).dropDuplicates(["district_id", "extracted_name", "name"])


CANDIDATES = "array<struct<place_id: string, name: string, formatted_address: string, geometry: struct<location: struct<lat: double, lng: double>>, types: array<string>>>"


def from_geocoder(wanted: DataFrame, cache: DataFrame, districts: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """wanted(district_id, name) -> locations by cached answers: inside the district's box and of a valid type.

    A candidate whose place_id the district has among locations is that location as it stands, wherever it lies.
    """
    boxes = districts.select(F.col("id").alias("district_id"), "ne_lat", "ne_lng", "sw_lat", "sw_lng")
    answers = cache.select("district_id", F.col("query").alias("normalized"), F.from_json("locations", f"candidates {CANDIDATES}").alias("a"))
    keyed = wanted.withColumn("normalized", text.normalize_location("name")).join(answers, ["district_id", "normalized"]).join(boxes, "district_id")
    one = keyed.withColumn("c", F.explode("a.candidates")).select("*", F.col("c.geometry.location.lat").alias("latitude"), F.col("c.geometry.location.lng").alias("longitude"), F.col("c.types").alias("types"))
    found = ["name", "normalized_name", "latitude", "longitude", "place_id", "formatted_address"]
    shown = ["district_id", F.col("name").alias("extracted_name")]
    fresh = [F.col("c.name").alias("name"), F.col("normalized").alias("normalized_name"), "latitude", "longitude", F.col("c.place_id").alias("place_id"), F.col("c.formatted_address").alias("formatted_address")]
    if locations is None:
        return scopes.valid_places(scopes.inside(one)).select(*shown, *fresh)
    held = locations.where("place_id is not null").groupBy("district_id", F.col("place_id").alias("_place")).agg(F.min(F.struct(*found)).alias("_held"))
    both = one.withColumn("_place", F.col("c.place_id")).join(held, ["district_id", "_place"], "left")
    new = scopes.valid_places(scopes.inside(both.where("_held is null"))).select(*shown, *fresh)
    return new.union(both.where("_held is not null").select(*shown, *[F.col(f"_held.{k}").alias(k) for k in found]))


def resolved(wanted: DataFrame, locations: DataFrame, streets: DataFrame, cache: DataFrame, districts: DataFrame) -> DataFrame:
    """wanted(district_id, name) -> its locations, with the stage that gave them: stored, gazetteer or geocoder.

    A later stage runs for names only that no earlier one knows. Blocked names give nothing. Stored
    locations count within their district.
    """
    columns = ["district_id", "extracted_name", "name", "normalized_name", "latitude", "longitude", "place_id", "formatted_address"]
    rows = scopes.not_blocked(wanted.select("district_id", "name").where(F.length(F.trim("name")) > 0).distinct(), districts).withColumn("_key", text.normalize_location("name"))
    known = locations.select(*[F.col(c).alias(f"l_{c}") for c in columns if c != "extracted_name"])
    stored = rows.join(known, (rows["district_id"] == known["l_district_id"]) & (rows["_key"] == known["l_normalized_name"]))
    stored = stored.select("district_id", F.col("name").alias("extracted_name"), *[F.col(f"l_{c}").alias(c) for c in columns[2:]])
    miss = lambda df, hit: df.join(hit.select("district_id", F.col("extracted_name").alias("name")).distinct(), ["district_id", "name"], "left_anti")
    second = miss(rows, stored).select("district_id", "name")
    gazetteer = from_gazetteer(second, streets, districts)
    geocoder = from_geocoder(miss(second, gazetteer), cache, districts, locations)
    parts = {"stored": stored, "gazetteer": gazetteer, "geocoder": geocoder}
    out = None
    for stage, df in parts.items():
        df = df.select(*columns, F.lit(stage).alias("stage"))
        out = df if out is None else out.unionByName(df)
    return out
