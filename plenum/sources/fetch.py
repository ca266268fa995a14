"""Fetching on the executors: one request a row, and a paged service as a data source.

Addresses are http(s), and files only where that is asked for. A request that fails gives its error and no
content, so that a batch goes on and the row can be asked for again.
"""

from __future__ import annotations

import http.client
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TIMEOUT = 30


def get(url: str, timeout: float = TIMEOUT, files: bool = False) -> tuple[bytes | None, str | None]:
    """(content, error) of one request; addresses of files are refused unless `files` is set."""
    if not url.lower().startswith(("http://", "https://", "file:") if files else ("http://", "https://")):
        return None, "ValueError: not an address that may be fetched"
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            return answer.read(), None
    except (OSError, ValueError, http.client.HTTPException) as wrong:
        return None, f"{type(wrong).__name__}: {wrong}"


def fetched(urls: DataFrame, key: str = "id", url: str = "url", timeout: float = TIMEOUT, files: bool = False) -> DataFrame:
    """(key, url, content, error): every address asked once, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                answers = [get(u, timeout, files) if u else (None, "no address") for u in part.column(url).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c for c, _ in answers], pa.binary()), pa.array([e for _, e in answers], pa.string())], [key, url, "content", "error"])

    rows = urls.select(key, url)
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {url} string, content binary, error string")


class _Stripe(InputPartition):
    def __init__(self, first: int):
        self.first = first


class PagedService(DataSource):
    """`paged`: (start, content) of a service's pages, read until one is empty, or as many as `total` rows fill.

    Options: url with {start} in it; page, the rows of a page; row, a string that every row holds, so that a page
    without it is empty; and either total or stripes. Stripe k reads pages k, k + stripes, ... up to its first
    empty one, which ends the register for it. A page that can not be had fails its task, which Spark tries again.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "start int, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.page, self.row = options["url"], int(options.get("page", 2000)), options.get("row", "").encode()
        self.total, self.files = int(options["total"]) if "total" in options else None, options.get("files", "false") == "true"
        self.stripes = int(options.get("stripes", 8)) if self.total is None else -(-self.total // self.page)

    def partitions(self) -> list[InputPartition]:
        return [_Stripe(k) for k in range(self.stripes)]

    def read(self, partition: _Stripe) -> Iterator[tuple]:
        start = partition.first * self.page
        while True:
            content, error = get(self.url.replace("{start}", str(start)), files=self.files)
            if error:
                raise OSError(error)
            if not content or self.row not in content:
                return
            yield start, content
            if self.total is not None:
                return
            start += self.stripes * self.page


def paged(spark: SparkSession, url: str, total: int | None = None, page: int = 2000, row: str = "", stripes: int = 8, files: bool = False) -> DataFrame:
    """The pages of a service of `total` rows, or without a total those up to the first empty one."""
    spark.dataSource.register(PagedService)
    reader = spark.read.format("paged").option("url", url).option("page", page).option("row", row).option("files", str(files).lower())
    return (reader.option("stripes", stripes) if total is None else reader.option("total", total)).load()
