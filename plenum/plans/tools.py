"""The three tools that programs call, with their declared answers. An error is an answer, not an exception."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.operators import scopes
from plenum.plans.api import SHORT, Council, NotFound

#: Input and output of each tool, as JSON schemas.
SCHEMAS = {
    "search": {
        "input": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "district": {"type": "string"}}},
        "output": {"documents": "array<struct<id: bigint, number: string, title: string, excerpt: string>>", "minutes": "array<struct<id: bigint, meeting_id: bigint, title: string, minutes: string>>"},
    },
    "document": {"input": {"type": "object", "required": ["number"], "properties": {"number": {"type": "string"}}}, "output": {"json": "string"}},
    "archive": {
        "input": {"type": "object", "properties": {"days_ago": {"type": "integer", "default": scopes.DEFAULT_DAYS}, "types": {"type": "string"}, "district": {"type": "string"}, "party": {"type": "string"}}},
        "output": {"documents": "array<struct<id: bigint, number: string, title: string>>"},
    },
}


def _listed(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def search(council: Council, query: str, district: str | None = None) -> dict:
    """At most SHORT documents and minutes."""
    try:
        found = council.search_tool(query, district)
    except NotFound as wrong:
        return {"error": str(wrong)}
    return {name: _listed(rows.limit(SHORT)) for name, rows in found.items()}


def document(council: Council, number: str) -> dict:
    """One document whole, as JSON."""
    row = council.document_json(number).first()
    return {"error": "no such document"} if row is None else {"json": row["json"]}


def archive(council: Council, today, days_ago: int = scopes.DEFAULT_DAYS, types: str = "", district: str | None = None, party: str | None = None) -> dict | DataFrame:
    """Documents of the last days, without a limit: the answer is a DataFrame, an error a dict."""
    try:
        return council.archive(today, int(days_ago), types, district, party)
    except (NotFound, ValueError) as wrong:
        return {"error": str(wrong)}


def catalog_sizes(spark, paths: dict[str, str]) -> DataFrame:
    """(name, bytes, percent of 10 GB, band) of tables by path, from the files' own listing."""
    from plenum.functions import text

    out = None
    for name, path in paths.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.lit(name).alias("name"), "length")
        out = files if out is None else out.union(files)
    sized = out.groupBy("name").agg(F.sum("length").alias("bytes"))
    percent = F.round(F.col("bytes") * 100.0 / (10 * 1024**3), 1)
    return sized.select("name", "bytes", text.human_size("bytes").alias("size"), percent.alias("percent"), text.band(percent).alias("band"))
