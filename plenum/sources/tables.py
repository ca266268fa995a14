"""Reading and writing the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.schemas import SCHEMAS

#: The districts in their order.
DISTRICTS = ["Hamburg-Mitte", "Altona", "Eimsbüttel", "Hamburg-Nord", "Wandsbek", "Bergedorf", "Harburg"]


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A domain table of Parquet files, with its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{base}/{name}")


def read_jdbc(spark: SparkSession, url: str, name: str, properties: dict, parts: int = 16) -> DataFrame:
    """A domain table of a database, read in ranges of its id."""
    ends = spark.read.jdbc(url, f"(select min(id) a, max(id) b from {name}) t", properties=properties).first()
    if ends["a"] is None:
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.jdbc(url, name, column="id", lowerBound=ends["a"], upperBound=ends["b"] + 1, numPartitions=parts, properties=properties)


def append(df: DataFrame, base: str, name: str) -> None:
    df.write.mode("append").parquet(f"{base}/{name}")


def refresh(df: DataFrame, base: str, name: str, partition_by: tuple = ()) -> None:
    """Replace a table whole. df must not read the same path."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{base}/{name}")


def seeds(spark: SparkSession) -> DataFrame:
    """(id, name, ord) of the districts."""
    return spark.createDataFrame([(k, n, k) for k, n in enumerate(DISTRICTS, 1)], "id bigint, name string, ord int")


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Temp views of all tables for SQL; documents only as the public see them."""
    for name, df in tables.items():
        if name == "documents":
            df = df.where(~F.col("non_public"))
        df.createOrReplaceTempView(name)


def console(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Any SQL over the given tables."""
    register(spark, tables)
    return spark.sql(text)


#: Keys by which large tables are laid out together, so that their joins move nothing.
BUCKETS = {"meetings": "id", "agenda_items": "meeting_id", "attendances": "meeting_id"}


def lay_out(df: DataFrame, name: str, table: str, buckets: int = 512) -> None:
    """Save a domain table in the warehouse, bucketed and sorted by its join key.

    Choose buckets so that one fits an executor's memory: at 100 TB with 512 MB a bucket, some 200,000.
    """
    key = BUCKETS[name]
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
