"""What the operators of this subpackage share: tables in the shared folder, and batches of documents as bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.session import ship


def prepared(spark: SparkSession) -> SparkSession:
    """The session with this package on its executors, and with Arrow batches of at most 8 MB unless it sets another size.

    A batch stands in memory several times, in the JVM, on the way and in Python; tasks need no larger ones.
    """
    if spark.conf.get(BATCH_BYTES) in ("67108864b", "64MB"):
        spark.conf.set(BATCH_BYTES, "8MB")
    return ship(spark)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def shared_dir(spark: SparkSession, lasting: bool = False) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where the setting is absent (tests, a single machine) a folder of this machine stands in. Within
    scratch it is removed at the end, unless it is lasting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir() + "/plenum-shared"
    path = f"{base.rstrip('/')}/plenum-{uuid.uuid4().hex}"
    if not lasting and _passing.get() is not None:
        _passing.get().append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within, the tables that operators cut their lineage with are removed at the end.

    A query's rows are made of such tables when they are read, so write them before the end.
    """
    token = _passing.set([])
    try:
        yield
    finally:
        for path in _passing.get():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _passing.reset(token)


def written(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: a cut in the lineage that outlives executors.

    With compact its rows are dealt to files of the advisory size first, for slim tables that would else be as
    many small files as the scan had tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    (df.hint("rebalance") if compact else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, body): the text as UTF-8 bytes, null as empty."""
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))


def bodies(batches: Iterator[pa.RecordBatch], most: int = 16 << 20) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Keys and bytes of at most about `most` bytes of text at a time; one document is never split."""
    for batch in batches:
        keys, column = batch.column("doc_id"), batch.column("body")
        sizes = pa.compute.binary_length(column).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held + n > most and i > start:
                yield keys.slice(start, i - start), column.slice(start, i - start).to_pylist()
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield keys.slice(start), column.slice(start).to_pylist()
