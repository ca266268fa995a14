from pyspark.sql import functions as F
from support import column

from plenum.functions.stem import german, stem, stems
from plenum.operators import tops
from plenum.plans import index
from plenum.sources import tables


def documents(spark):
    rows = [(1, "Haus", "ein Haus am Weg", "1"), (2, "Weg", "Häuser und Weg", "2"), (3, None, "Haus", "3"), (4, "Steg", "Steg am Weg zum Haus", "4")]
    return spark.createDataFrame(rows, "id long, title string, full_text string, number string")


def test_same_as_scan(spark, tmp_path):
    docs = documents(spark)
    index.write(index.postings(docs), str(tmp_path / "i"))
    stored = index.read(spark, str(tmp_path / "i"))
    for query in ("haus", "Haus Weg", "weg haus am", "nirgends", "?", "haus nirgends"):
        expected = [(r["id"], r["rank"]) for r in tops.found(docs, query).select("id", "rank").collect()]
        assert [tuple(r) for r in index.found(stored, query).collect()] == expected
    plan = index.found(stored, "haus weg")._jdf.queryExecution().toString()
    assert "PartitionFilters: [part" in plan.replace("isnotnull(", "").replace("(", "") or "PartitionFilters: [part" in plan
    assert "PushedFilters: [In(term" in plan


def test_stems(spark):
    docs = documents(spark)
    expected = [(r["id"], r["rank"]) for r in tops.found(docs, "häuser", stem=stems).select("id", "rank").collect()]
    assert [tuple(r) for r in index.found(index.postings(docs, stems), "häuser", stem).collect()] == expected and len(expected) == 3


def test_laid_out_tables_join_without_exchange(spark):
    meetings = spark.range(100).selectExpr("id", "id % 7 as committee_id")
    items = spark.range(300).selectExpr("id", "id % 100 as meeting_id")
    tables.lay_out(meetings, "meetings", "plenum_test_meetings", 4)
    tables.lay_out(items, "agenda_items", "plenum_test_items", 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = spark.table("plenum_test_items").join(spark.table("plenum_test_meetings").withColumnRenamed("id", "meeting_id"), "meeting_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 300 and len(column(joined.limit(1), "committee_id")) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table plenum_test_meetings")
        spark.sql("drop table plenum_test_items")


def test_trigrams(spark, tmp_path):
    docs = documents(spark)
    index.write(index.trigrams(docs, "full_text"), str(tmp_path / "g"))
    stored = index.read(spark, str(tmp_path / "g"), weighted=False)
    for term in ("haus", "AM WEG", "us a", "x", "", "nirgends", "ä", "%"):
        assert sorted(column(index.containing(stored, docs, "full_text", term), "id")) == sorted(column(docs.where(F.contains(F.lower("full_text"), F.lit(term.lower()))), "id")), term


def test_layout():
    assert index.layout(0) == (1, 1) and index.layout(index.FILE_ROWS + 1) == (2, 1)
    folders, files = index.layout(10**13)
    assert folders == index.FOLDERS and 10**13 / folders / files <= index.FILE_ROWS


def test_german_search(spark):
    docs = documents(spark)
    assert sorted(column(tops.found(docs, "die Häuser und das", stem=german), "id")) == sorted(column(tops.found(docs, "haus", stem=german), "id"))
    assert tops.found(docs, "die und", stem=german).count() == 0
