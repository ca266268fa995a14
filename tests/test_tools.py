import json

import pytest
from pyspark.sql import functions as F
from support import DATA

from plenum.plans import tools
from plenum.plans.analogue import council
from plenum.streaming import events

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def test_tools(spark):
    c, today = council(spark, str(DATA)), F.lit("1998-06-15").cast("date")
    found = tools.search(c, "widget")
    assert set(found) == {"documents", "minutes"} and len(found["documents"]) <= 5
    assert tools.search(c, "widget", "nowhere") == {"error": "no such district"}
    number = c.documents.select("number").first()["number"]
    assert json.loads(tools.document(c, number)["json"])["number"] == number
    assert tools.document(c, "none") == {"error": "no such document"}
    assert tools.archive(c, today, 60).columns == ["id", "number", "title"]
    assert "error" in tools.archive(c, today, -1) and "error" in tools.archive(c, today, district="nowhere")


def test_log(spark, tmp_path):
    rows = spark.createDataFrame([("192.0.2.77", "search", {"q": "x"}), ("2001:db8:1:2::3", "map", None)], "ip string, name string, params map<string, string>").withColumn("time", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    for _ in range(2):
        events.track(rows, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 4 and {r["ip"] for r in log.collect()} == {"192.0.2.0", "2001:db8:1::"}
    assert {r["properties"] for r in log.collect()} == {'{"q":"x"}', None}


def test_sizes(spark):
    (row,) = tools.catalog_sizes(spark, {"part": f"{DATA}/part.parquet"}).collect()
    assert row["bytes"] == (DATA / "part.parquet").stat().st_size and row["band"] == "success"


def test_bad_slugs(spark):
    from plenum.plans.api import NotFound

    c = council(spark, str(DATA))
    for slug in ("", "title", "title-", "a-9999999999999999999999", "a-x1", "a-²"):
        with pytest.raises(NotFound):
            c.document(slug)
        with pytest.raises(NotFound):
            c.meeting(slug)
