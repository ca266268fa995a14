"""A pipeline over documents: five stages that each write Parquet for the next one.

Documents that the quality classifier rejects go; of each group of near copies one stays; documents that
hold benchmark passages go; sources are mixed to their target weights, with repeats; and the ids of what is
left are written to token files and read back. All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plenum.llm import decontaminate, mixture, preference, simhash, token_stream
from plenum.llm.common import prepared, scratch, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score at least the threshold."""
    return preference.keep(docs, prepared(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    prepared(spark)
    return simhash.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a window of the benchmark."""
    return decontaminate.clean(docs, prepared(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixture.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document in the token files."""
    prepared(spark)
    return token_stream.token_rows(docs)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_free),
    ("mixture_to_targets", mix),
    ("token_output", tokens),
]

#: Learned scores and a subword vocabulary have no SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what stages leave besides their results and the token files is removed."""
    prepared(spark)
    docs, base = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}_{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
