"""Search indexes as tables: postings by term, or by three characters, so that a query does not read the texts.

Postings are partitioned by a hash of the term and sorted by it within files, so a search touches the
partitions of its terms, and in them the row groups whose range holds them. A frequent term's postings are
spread over several files by the document's hash; nothing is gathered by term. How many partitions and files
there are follows from the number of postings, and the partitions' number stands in their folder's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.functions import search

#: Postings of a file, about; folders at most, beyond which each gets more files.
FILE_ROWS, FOLDERS = 4_000_000, 4096


def layout(n: int) -> tuple[int, int]:
    """(folders, files in each) for n postings."""
    folders = min(FOLDERS, max(1, -(-n // FILE_ROWS)))
    return folders, max(1, -(-n // (FILE_ROWS * folders)))


def part_of(term, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def postings(documents: DataFrame, stem=None, **parts: str) -> DataFrame:
    """(term, id, weight): the summed weight of every term in every document; parts as for search.vector."""
    v = search.vector(stem, **(parts or {"A": "title", "B": "full_text"}))
    words = documents.select("id", F.explode(v).alias("w"))
    return words.groupBy(F.col("w.term").alias("term"), "id").agg(F.round(F.sum("w.weight"), 6).alias("weight"))


def trigrams(documents: DataFrame, c: str) -> DataFrame:
    """(term, id): every three characters that follow one another in the lower-cased text, once a document."""
    text = documents.select("id", F.lower(c).alias("_t")).where(F.length("_t") >= 3)
    grams = F.transform(F.sequence(F.lit(1), F.length("_t") - 2), lambda at: F.substr("_t", at, F.lit(3)))
    return text.select("id", F.explode(F.array_distinct(grams)).alias("term")).select("term", "id")


def containing(index: DataFrame, documents: DataFrame, c: str, term: str) -> DataFrame:
    """Documents whose text contains the term in any case; those that lack one of its trigrams are not read."""
    low = term.lower()
    grams = sorted({low[k : k + 3] for k in range(len(low) - 2)})
    if grams:
        rows = _pruned(index, grams)
        documents = documents.join(rows.groupBy("id").agg(F.count("*").alias("_n")).where(F.col("_n") == len(grams)).select("id"), "id", "left_semi")
    return documents.where(search.contains_term(c, term))


def write(rows: DataFrame, path: str, n: int | None = None) -> None:
    """Write postings below path, a folder for each part of the terms; n, their number, is counted if not given."""
    parts, files = layout(rows.count() if n is None else n)
    dealt = rows.withColumn("part", part_of("term", parts)).withColumn("parts", F.lit(parts)).repartition("part", F.pmod(F.xxhash64("id"), F.lit(files)))
    dealt.sortWithinPartitions("part", "term", "id").write.partitionBy("parts", "part").parquet(path)


def read(spark: SparkSession, path: str, weighted: bool = True) -> DataFrame:
    return spark.read.schema(f"term string, id bigint, {'weight double, ' if weighted else ''}parts int, part int").parquet(path)


def found(index: DataFrame, query: str, stem=None) -> DataFrame:
    """(id, rank) of documents that hold all terms of the query, best first."""
    wanted = search.terms(query)
    if stem is not None:
        wanted = list(dict.fromkeys(map(stem, wanted)))
    rows = _pruned(index, wanted) if wanted else index.limit(0)
    hits = rows.groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("rank"))
    return hits.where(F.col("n") == len(wanted)).select("id", "rank").orderBy(F.col("rank").desc(), "id")


def _pruned(index: DataFrame, wanted: list[str]) -> DataFrame:
    """The postings of a query's few terms; their folders as constants, so that the others are pruned in planning."""
    rows = index.where(F.col("term").isin(wanted))
    if "parts" not in index.columns:
        return rows
    parts = index.select("parts").first()
    if parts is None:
        return rows
    held = index.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in wanted])).alias("t")).select(part_of("t", parts["parts"])).distinct().collect()
    return rows.where(F.col("part").isin([r[0] for r in held]))
