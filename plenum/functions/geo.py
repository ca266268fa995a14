"""Column functions on points and boxes of plain latitudes and longitudes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenum.functions.text import col

#: Numbers of the city's districts, and latitudes between which its points lie.
DISTRICT_NUMBERS = {"Hamburg-Mitte": 1, "Altona": 2, "Eimsbüttel": 3, "Hamburg-Nord": 4, "Wandsbek": 5, "Bergedorf": 6, "Harburg": 7}
LATITUDES = (53, 54)


def out_of_bounds(lat, lng, ne_lat="ne_lat", ne_lng="ne_lng", sw_lat="sw_lat", sw_lng="sw_lng") -> Column:
    """Strictly outside the box."""
    return (col(lat) > col(ne_lat)) | (col(lat) < col(sw_lat)) | (col(lng) > col(ne_lng)) | (col(lng) < col(sw_lng))


def centre(ne_lat="ne_lat", ne_lng="ne_lng", sw_lat="sw_lat", sw_lng="sw_lng") -> tuple[Column, Column]:
    """Latitude and longitude of the middle of a box."""
    return col(sw_lat) + (col(ne_lat) - col(sw_lat)) / 2.0, col(sw_lng) + (col(ne_lng) - col(sw_lng)) / 2.0


def ordered_point(pos) -> tuple[Column, Column]:
    """"a b" as (latitude, longitude): as it stands if a can be a latitude here, else swapped."""
    parts = F.split(F.trim(col(pos)), r"\s+")
    a, b = parts[0].try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(a.between(*LATITUDES), a).otherwise(b), F.when(a.between(*LATITUDES), b).otherwise(a)


def district_number(name) -> Column:
    """The number of a district by its name, or null."""
    pairs = [F.lit(x) for kv in DISTRICT_NUMBERS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(name))


def key_districts(keys) -> Column:
    """The district numbers in street keys like "02;4;01", distinct and in order."""
    numbers = F.transform(col(keys), lambda k: F.get(F.split(k, ";"), F.lit(1)).try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.isNotNull())))


def cell(lat, lng, size: float) -> tuple[Column, Column]:
    """Row and column of the grid cell of a point, for clusters of markers."""
    return F.floor(col(lat) / size), F.floor(col(lng) / size)
