"""Changes of state as pure functions from what is stored and what a source shows to what is stored next.

Each returns the whole new table, to be written to a new path; no table is read and overwritten in one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions import text
from plenum.functions.text import col


def next_ids(stored: DataFrame, new: DataFrame, key: str = "id", buckets: int = 1024) -> DataFrame:
    """New rows with ids above the largest stored one: different, the same in a rerun, and with gaps.

    Rows are counted within buckets of a hash, so no task numbers them all: id = top + bucket + 1 + place * buckets.
    """
    others = [F.col(f"`{c}`") for c in new.columns if c != key]
    bucket = F.pmod(F.xxhash64(*others), F.lit(buckets))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*others)) - 1
    top = stored.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    numbered = new.withColumn("_bucket", bucket).withColumn("_place", place).join(F.broadcast(top))  # one row
    return numbered.withColumn(key, F.col("_top") + F.col("_bucket") + 1 + F.col("_place") * buckets).drop("_top", "_bucket", "_place")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], update: bool = True) -> DataFrame:
    """Stored rows with the columns of the incoming row of their keys, and incoming rows that are new.

    With update=False stored rows stay as they are (find or create). Of incoming rows with equal keys the
    last by all columns counts.
    """
    others = [c for c in incoming.columns if c not in keys]
    if others:
        incoming = incoming.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in others])
    else:
        incoming = incoming.distinct()
    a, b = stored.withColumn("_a", F.lit(True)).alias("a"), incoming.withColumn("_b", F.lit(True)).alias("b")
    both = a.join(b, reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]), "full")
    out = []
    for c in stored.columns:
        if c in keys:
            out.append(F.when(F.col("_a"), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
        elif c in incoming.columns:
            fresh = F.col("_b") & (F.lit(update) | F.col("_a").isNull())
            out.append(F.when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
        else:
            out.append(F.col(f"a.{c}").alias(c))
    return both.select(*out)


def missing_ids(stored: DataFrame, newest: DataFrame, key: str = "ext_id") -> DataFrame:
    """(district_id, ext_id): ids above each district's high-water mark up to the newest that its index page shows.

    newest(district_id, newest, oldest): the mark is the larger of oldest and the largest stored id.
    """
    mark = stored.groupBy("district_id").agg(F.max(key).alias("most"))
    span = newest.join(mark, "district_id", "left").withColumn("mark", F.greatest("oldest", F.coalesce("most", F.lit(0))))
    return span.where(F.col("newest") > F.col("mark")).select("district_id", F.explode(F.sequence(F.col("newest"), F.col("mark") + 1, F.lit(-1))).alias(key))


def months_to_visit(meetings: DataFrame, districts: DataFrame, today) -> DataFrame:
    """(district_id, month): from nine months ahead back to two months before the last titled meeting (or the district's oldest date)."""
    last = meetings.where("title is not null").groupBy("district_id").agg(F.max("date").alias("last"))
    span = districts.select(F.col("id").alias("district_id"), "oldest_meeting_date").join(last, "district_id", "left")
    first = F.trunc(F.add_months(F.coalesce("last", "oldest_meeting_date"), -2), "MM")
    top = F.trunc(F.add_months(col(today), 9), "MM")
    return span.where(first <= top).select("district_id", F.explode(F.sequence(top, first, F.expr("interval -1 month"))).alias("month"))


def roster(stored: DataFrame, snapshot: DataFrame, keys: list[str], scope: list[str]) -> DataFrame:
    """Snapshot sync with soft delete: rows seen are written and active, rows of the snapshot's scope not seen are inactive.

    scope are the columns that say whose roster it is (a committee, a party); only scopes that the snapshot
    has are touched, so a page that could not be read changes nothing. Rows without a name are no rows.
    """
    seen = snapshot.withColumn("inactive", F.lit(False))
    seen = seen.where(F.length(F.trim("name")) > 0) if "name" in snapshot.columns else seen
    touched = snapshot.select(*scope).distinct().withColumn("_touched", F.lit(True))
    gone = stored.join(touched, scope, "left").join(seen.select(*keys).distinct().withColumn("_seen", F.lit(True)), keys, "left")
    marked = gone.withColumn("inactive", F.when(F.col("_touched") & F.col("_seen").isNull(), True).otherwise(F.col("inactive"))).select(*stored.columns)
    return upsert(marked, seen, keys)


def expire(parties: DataFrame, members: DataFrame, expired: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Expired parties (party_id) become inactive, with all their members."""
    gone = expired.select("party_id").distinct().withColumn("_gone", F.lit(True))
    flag = lambda df: df.withColumn("inactive", F.coalesce("_gone", F.lit(False)) | F.col("inactive")).drop("_gone")
    own = flag(parties.join(gone.withColumnRenamed("party_id", "id"), "id", "left")).select(*parties.columns)
    return own, flag(members.join(gone, "party_id", "left")).select(*members.columns)


def replaced(stored: DataFrame, snapshot: DataFrame, scope: list[str], keys: list[str]) -> DataFrame:
    """Snapshot sync with hard delete within the snapshot's scopes: kept where still named, else gone; new ones added."""
    touched = snapshot.select(*scope).distinct()
    outside = stored.join(touched, scope, "left_anti")
    kept = stored.join(snapshot.select(*scope, *keys).distinct(), scope + keys, "left_semi")
    new = snapshot.join(stored.select(*scope, *keys).distinct(), scope + keys, "left_anti").dropDuplicates(scope + keys)
    return outside.unionByName(kept).unionByName(new, allowMissingColumns=True).select(*stored.columns)


def agenda(stored: DataFrame, snapshot: DataFrame, meetings: DataFrame, today) -> DataFrame:
    """Agenda items after a visit: of meetings from today on replaced, of past ones updated by number.

    snapshot(meeting_id, number, ...): rows without a number are no items, but tell that the meeting was visited.
    """
    rows = snapshot.where(F.length(F.trim("number")) > 0)
    ahead = meetings.where(F.col("date") >= col(today)).select(F.col("id").alias("meeting_id")).join(snapshot.select("meeting_id").distinct(), "meeting_id", "left_semi")
    past = stored.join(ahead, "meeting_id", "left_anti").select(*stored.columns)
    return upsert(past, rows, ["meeting_id", "number"])


def without_orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent exists."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col("id").alias(key)), key, "left_semi").select(*rows.columns)


def nullified(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows with the key null where the parent is gone."""
    known = parents.select(F.col("id").alias(key)).distinct().withColumn("_k", F.lit(True))
    return rows.join(known, key, "left").withColumn(key, F.when(F.col("_k"), F.col(key))).select(*rows.columns)


def derived(items: DataFrame) -> DataFrame:
    """Items with the words of their minutes and result counted anew."""
    return items.withColumn("word_count", text.word_count("minutes", "result"))


def with_averages(committees: DataFrame, averages: DataFrame) -> DataFrame:
    """Committees with the averages (committee_id, word_count, duration) written back."""
    own = averages.select(F.col("committee_id").alias("id"), F.col("word_count").alias("_w"), F.col("duration").alias("_d"))
    return committees.join(own, "id", "left").withColumn("average_word_count", F.col("_w")).withColumn("average_duration", F.coalesce("_d", "average_duration")).select(*committees.columns)


def to_cache(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The geocoder's cache with new answers whose status is OK; known questions keep their answer."""
    good = answers.where("status = 'OK'").select("district_id", "query", "locations")
    return upsert(cache, good, ["district_id", "query"], update=False)


def added_links(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Links with new ones; a repeated analysis adds nothing."""
    return stored.unionByName(new.select(*stored.columns)).dropDuplicates(["document_id", "location_id"])


def backfilled_addresses(locations: DataFrame, streets: DataFrame) -> DataFrame:
    """Locations with the register's address where they came from it and have none; others stay as they are."""
    known = streets.where("street_key is not null").groupBy(F.concat(F.lit("gazetteer:"), "street_key").alias("place_id")).agg(F.min(text.address("name", "postal_code", "quarter")).alias("_address"))
    rows = locations.join(known, "place_id", "left")
    return rows.withColumn("formatted_address", F.coalesce(text.blank_to_null("formatted_address"), F.col("_address"))).select(*locations.columns)


def owned_attachments(attachments: DataFrame, kind: str = "Document", key: str = "document_id") -> DataFrame:
    """Attachments of one kind of owner with the tag and id that name any owner: a one-off change of shape."""
    return attachments.withColumnRenamed(key, "attachable_id").withColumn("attachable_type", F.when(F.col("attachable_id").isNotNull(), F.lit(kind)))
