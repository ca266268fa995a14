"""Files that a crawl has landed: pages, documents, images, and the text in them."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from plenum.functions import text

#: What pages say instead of content.
MOVED, SIGN_IN, NO_INFORMATION = "Object moved", "noauth.asp", "Keine Information verf&uuml;gbar"


def pages(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """(path, source): one landed page a file. The text reader knows no encoding for whole files, so bytes are decoded."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", encoding).alias("source"))


def usable(rows: DataFrame, c: str = "source") -> DataFrame:
    """Pages that show their content."""
    return rows.where(~text.has_marker(c, MOVED, SIGN_IN, NO_INFORMATION))


def protocols(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of landed files that are PDF."""
    return spark.read.format("binaryFile").load(path).where(F.startswith(F.col("content").cast("string"), F.lit("%PDF"))).select("path", "content")


#: Escapes in the strings of a PDF.
_ESCAPE, _NAMED = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.DOTALL), {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r\n": b""}


def _escaped(found: re.Match) -> bytes:
    code = found[1]
    return bytes([int(code, 8) & 255]) if code.isdigit() and code < b"8" else _NAMED.get(code, code)


def extract_text(name: str | None, content: bytes | None) -> str | None:
    """The text in a file: plain text, HTML, Office XML, or the text operators of a simple PDF; null for others."""
    if content is None:
        return None
    if content[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            parts = [n for n in archive.namelist() if re.fullmatch(r"(word/document|xl/sharedStrings|ppt/slides/slide\d+|content)\.xml", n)]
            return "\n".join(" ".join(t for t in ElementTree.fromstring(archive.read(n)).itertext() if t.strip()) for n in sorted(parts)) or None
    if content[:4] == b"%PDF":
        shown = []
        for head, body in re.findall(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", content, re.DOTALL):
            if b"FlateDecode" in head:
                try:
                    body = zlib.decompress(body)
                except zlib.error:
                    continue
            for literal in re.findall(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|\[(.*?)\]\s*TJ", body, re.DOTALL):
                pieces = [literal[0]] if literal[0] else re.findall(rb"\(((?:[^()\\]|\\.)*)\)", literal[1])
                shown.append(_ESCAPE.sub(_escaped, b"".join(pieces)).decode("latin-1"))
        return "\n".join(shown) or None
    if content[:1] == b"<" or (name or "").lower().endswith((".html", ".htm")):
        from plenum.functions.markup import visible_text

        return visible_text(content.decode("utf-8", "replace"))
    if b"\0" in content[:1024]:
        return None
    return content.decode("utf-8", "replace")


def text_or_reason(name: str | None, content: bytes | None) -> tuple[str | None, str | None]:
    """extract_text, or why a damaged file has none: one file must not end the others."""
    try:
        return extract_text(name, content), None
    except Exception as wrong:
        return None, f"{type(wrong).__name__}: {wrong}"[:200]


@F.pandas_udf(StructType([StructField("content", StringType()), StructField("error", StringType())]))
def file_text(path: pd.Series, content: pd.Series) -> pd.DataFrame:
    """text_or_reason of files."""
    return pd.DataFrame([text_or_reason(p, c) for p, c in zip(path, content)], columns=["content", "error"], dtype=object)


def attachments(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content, error): landed files with their text, null bytes left out, or why there is none."""
    rows = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    found = rows.select("path", name.alias("name"), file_text("path", "content").alias("t"))
    return found.select("path", "name", F.translate("t.content", "\0", "").alias("content"), F.col("t.error").alias("error"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of landed images."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,gif}").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
