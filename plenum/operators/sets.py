"""Unions, differences and intersections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.text import col


def merged_names(a, b) -> Column:
    """Distinct names of two arrays, those of the first in front."""
    return F.array_union(F.coalesce(col(a), F.array().cast("array<string>")), F.coalesce(col(b), F.array().cast("array<string>")))


def either(*parts: DataFrame) -> DataFrame:
    """Distinct rows of all parts."""
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def stacked(**parts: DataFrame) -> DataFrame:
    """All parts under one another with their name as source; columns that a part lacks are null."""
    named = [df.withColumn("source", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def minus(stored: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows whose keys are not current; nulls match nulls."""
    other = current.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return stored.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_anti")


def overlap(a, b) -> Column:
    return F.arrays_overlap(col(a), col(b))


def common(a, b) -> Column:
    return F.array_intersect(col(a), col(b))
