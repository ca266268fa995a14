import datetime
import os

from pyspark.sql import functions as F

from plenum.operators import sync
from plenum.streaming import ingest, throttle

SCHEMA = "event_id long, ts timestamp_ntz, user_id long"


def events(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(seconds=40 * k), k % 3) for k in range(200)]
    return spark.createDataFrame(rows, SCHEMA)


def test_stream_is_batch(spark, tmp_path):
    base = str(tmp_path)
    events(spark).repartitionByRange(3, "ts").write.parquet(f"{base}/in")
    for k, part in enumerate(sorted((tmp_path / "in").glob("part-*"))):
        os.utime(part, (1_700_000_000 + 60 * k,) * 2)  # files are read in order of their time
    stream = throttle.stream(throttle.read_events(spark, f"{base}/in", SCHEMA), limit=2, late="1 hour")
    throttle.run(stream, f"{base}/out", f"{base}/check")
    expected = throttle.windows(events(spark), limit=2).withColumn("window_start", F.col("window_start").cast("timestamp"))
    got = spark.read.parquet(f"{base}/out")
    last = events(spark).agg(F.max("ts").cast("timestamp") - F.expr("interval 1 hour")).first()[0]
    closed = expected.where(F.col("window_start") + F.expr("interval 5 minutes") <= F.lit(last))
    assert got.exceptAll(closed).count() == 0 and closed.exceptAll(got).count() == 0 and got.count() > 0


def test_flagged(spark):
    found = throttle.flagged(events(spark), limit=2).groupBy("allowed").count().collect()
    counted = throttle.windows(events(spark), limit=2).agg(F.sum(F.greatest(F.col("requests") - 2, F.lit(0)))).first()[0]
    assert {r["allowed"]: r["count"] for r in found}[False] == counted


def test_ingest(spark, tmp_path):
    base = tmp_path / "pages"
    base.mkdir()
    (base / "paper-12.html").write_bytes('<h1>Drucksache - 21-1</h1><table class="risdeco"><tr><td class="text1">Weg</td></tr></table>'.encode("latin-1"))
    for _ in range(2):
        ingest.work_off(ingest.landed(spark, str(base)), ingest.into(str(tmp_path / "out")), str(tmp_path / "check"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["ext_id"], r["number"], r["title"]) for r in rows] == [(12, "21-1", "Weg")]


def test_links_are_added_once(spark):
    a = spark.createDataFrame([(1, 1)], "document_id long, location_id long")
    assert sync.added_links(a, spark.createDataFrame([(1, 1), (1, 2)], "document_id long, location_id long")).count() == 2


def test_revisits(spark):
    import datetime

    from plenum.streaming.ingest import work_list

    now = datetime.datetime(2024, 5, 31, 12)
    ago = lambda **x: now - datetime.timedelta(**x)
    documents = spark.createDataFrame([(1, 1, "a", ago(days=6), ago(hours=5)), (2, 1, "a", ago(days=8), ago(hours=5)), (3, 1, "a", ago(days=1), ago(hours=3)), (4, 1, None, ago(days=1), ago(hours=1))], "id long, district_id long, title string, created_at timestamp_ntz, updated_at timestamp_ntz")
    meetings = spark.createDataFrame([(k, 1, ago(days=d).date()) for k, d in ((1, 0), (2, 14), (3, 15), (4, 29), (5, 30), (6, 4000), (7, 31), (8, -400))], "id long, district_id long, date date")
    items = spark.createDataFrame([(70, 7, 5, None, None), (71, 6, None, None, None), (50, 5, None, "m", None)], "id long, meeting_id long, ext_id int, minutes string, result string")
    found = sorted((r["tier"], r["kind"], r["id"]) for r in work_list(documents, meetings, items, F.lit(now).cast("timestamp_ntz")).collect())
    assert found == sorted([("today", "meeting", 1), *[("changing", "meeting", k) for k in (1, 2, 8)], ("changing", "document", 1), ("changing", "document", 4), ("slow", "meeting", 5), ("slow", "meeting", 6), ("slow", "item", 70)])
