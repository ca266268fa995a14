"""Mixing sources to target weights by hash thresholds, with DataFrame functions only.

A document is taken if its hash lies below its source's threshold. The threshold is found from histograms:
words are summed by source and hash bucket, the bucket in which the budget runs out is cut again by the
next bits, and only its documents are read for that. Nothing is sorted; a hot source is only a partial sum.
What the document at the threshold is too large for is filled in further rounds, each with a threshold above
the last one among documents that are small enough for the rest, until there is none left; each round after the
first takes one at least. Rows that repeat have one hash: of those at the threshold as many are taken as fit,
told apart by a number among equal rows. At last one document is added if the one nearest to what is then left
brings the sum nearer to its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.common import written

HASH_BITS, LEVEL_BITS = 60, 12
#: The last number of a rule that takes all rows of equal hash.
ALL = (1 << 63) - 1
#: Sources up to this number are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 20_000


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, text, source) of docs with size (words of the text, null: 0) and hash, 60 bits of doc_id and text."""
    return _sized(docs.select("doc_id", "text", "source"))


def _sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select("*", size.alias("size"), F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - HASH_BITS).alias("hash"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Sources in code point order, null last, weigh `weights`, repeating, and share `share` times all sizes.
    None gets over `most` times its size; the excess goes to the others by weight until none is above.
    That is the level at which the water stands: min(most * size, level * weight), found by running sums
    over sources in order of most * size / weight.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap"), (F.lit(float(share)) * F.sum("source_size").over(everything)).alias("budget"), "rank")
    below = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    full = ranked.withColumn("full", level * F.col("weight") >= F.col("cap"))
    left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(left * F.col("weight") / open_weight)
    return full.select("source", "source_size", target.alias("target"))


def _beside(rows: DataFrame, small: DataFrame, n: int, on: str = "source") -> DataFrame:
    """rows joined with the row of their source; null is a source."""
    small = small.withColumnRenamed(on, "_at")
    return rows.join(F.broadcast(small) if n <= BROADCAST_SOURCES else small, F.col(on).eqNullSafe(F.col("_at"))).drop("_at")


def _threshold(rows: DataFrame, open_: DataFrame, n_sources: int, name: str) -> DataFrame:
    """open_(source, left, low, most) with high and rest: documents of hashes from low to high and at most `most` words fill
    left but for rest, and the next one would be too much. With too few such documents high is above all hashes.
    Where the next ones are rows that repeat, `part` of those whose hash is high are taken, too, as many as fit.
    Sources without any such document are left out. Each level is one small table: a row for each open source.
    """
    found, state, at = [], open_.select("source", "left", "low", "most", F.lit(0).cast("long").alias("prefix")), 0
    while at < HASH_BITS:
        at += LEVEL_BITS
        bucket = F.shiftrightunsigned("hash", HASH_BITS - at)
        here = F.shiftrightunsigned("hash", HASH_BITS - at + LEVEL_BITS) == F.col("prefix")
        inside = _beside(rows, state, n_sources).where(here & (F.col("hash") >= F.col("low")) & (F.col("size") <= F.col("most")) & (F.col("size") > 0))
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.max("size").alias("one"), *[F.first(c).alias(c) for c in ("left", "low", "most")])
        own = Window.partitionBy("source")
        sums = sums.withColumn("before", F.sum("words").over(own.orderBy("bucket")) - F.col("words")).withColumn("few", F.sum("words").over(own) < F.col("left"))
        end = F.col("before") + F.col("words")
        edge = sums.withColumn("top", F.max("bucket").over(own)).where(F.when(F.col("few"), F.col("bucket") == F.col("top")).otherwise((F.col("before") < F.col("left")) & (end >= F.col("left"))))
        edge = written(edge.withColumn("left", F.col("left") - F.col("before")), f"edge_{name}_{at}")
        fits = F.col("words") <= F.col("left")
        last = F.lit(at == HASH_BITS) | (F.col("n") == 1) | fits
        high = F.when(F.col("few"), F.lit(1 << HASH_BITS)).otherwise(F.shiftleft(F.col("bucket") + fits.cast("long"), HASH_BITS - at))
        part = F.when(F.lit(at == HASH_BITS) & (F.col("n") > 1) & ~fits, F.floor(F.col("left") / F.col("one"))).otherwise(0).cast("long")
        rest = F.col("left") - F.when(fits, F.col("words")).otherwise(part * F.col("one"))
        found.append(edge.where(last).select("source", "low", high.alias("high"), "most", rest.alias("rest"), part.alias("part")))
        state = edge.where(~last).select("source", "left", "low", "most", F.col("bucket").alias("prefix"))
        if state.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def thresholds(rows: DataFrame, goal: DataFrame, n_sources: int) -> DataFrame:
    """rows(source, size, hash), goal(source, source_size, target) -> goal with copies and rules.

    Every document of the source is taken `copies` times, and once more if a rule (low, high, most, first, last)
    fits its hash, its size and its number among rows of equal hash. The words taken differ from the target by
    at most half of the smallest document that is left out and larger than that difference.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = written(goal.withColumn("copies", copies).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")), "goal")
    open_, rules, k = goal.where("left > 0").select("source", "left", F.lit(0).cast("long").alias("low"), F.lit(float("inf")).alias("most")), None, 0
    slim = rows.select("source", "size", "hash")
    while True:
        found = written(_threshold(slim, open_, n_sources, str(k)), f"found_{k}")
        rules = found if rules is None else written(rules.union(found), f"rules_{k}")
        open_ = found.where(F.col("high") < 1 << HASH_BITS).where("rest >= 1").select("source", F.col("rest").alias("left"), F.col("high").alias("low"), F.col("rest").alias("most"))
        if open_.isEmpty():
            break
        k += 1
    whole = _rule(F.col("low"), F.col("high"), F.col("most"), F.lit(1), F.lit(ALL))
    part = _rule(F.col("high"), F.col("high") + 1, F.col("most"), F.lit(1), F.col("part"))
    own = F.when(F.col("part") > 0, F.array(whole, part)).otherwise(F.array(whole))
    lists = written(rules.groupBy("source").agg(F.flatten(F.collect_list(own)).alias("rules"), F.min("rest").alias("rest")), "rules")
    open_ = lists.where("rest >= 1").withColumn("copies", F.lit(0))
    beside = numbered(_beside(slim, open_, n_sources), open_)
    by = F.struct(F.abs(F.col("size") - F.col("rest")).alias("by"), "hash", "size", "nth")
    near = written(beside.where((times("nth") == 0) & (F.col("size") < 2 * F.col("rest")) & (F.col("size") > 0)).groupBy("source").agg(F.min(by).alias("near")), "near")
    equal = _beside(slim, near, n_sources).where(F.col("hash") == F.col("near.hash")).groupBy("source", "near").agg(F.count("*").alias("n"))
    single = F.col("n") == 1
    one = _rule(F.col("near.hash"), F.col("near.hash") + 1, F.col("near.size"), F.when(single, 1).otherwise(F.col("near.nth")), F.when(single, F.lit(ALL)).otherwise(F.col("near.nth")))
    none = F.array().cast(lists.schema["rules"].dataType)
    lists = lists.join(equal.select(F.col("source").alias("_at"), F.array(one).alias("one")), F.col("source").eqNullSafe(F.col("_at")), "left")
    lists = lists.select(F.col("source").alias("_at"), F.concat("rules", F.coalesce("one", none)).alias("rules"))
    return goal.join(lists, F.col("source").eqNullSafe(F.col("_at")), "left").select("source", "source_size", "target", "copies", F.coalesce("rules", none).alias("rules"))


def _rule(low, high, most, first, last):
    return F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), most.cast("double").alias("most"), first.cast("long").alias("first"), last.cast("long").alias("last"))


def numbered(beside: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows beside their source's rules with nth: their number among rows of equal hash where a rule takes some of these, else 1."""
    some = lambda r: r["last"] < ALL
    if limits.where(F.exists("rules", some)).isEmpty():
        return beside.withColumn("nth", F.lit(1).cast("long"))
    cut = F.exists("rules", lambda r: some(r) & (F.col("hash") >= r["low"]) & (F.col("hash") < r["high"]))
    number = F.row_number().over(Window.partitionBy("source", "hash").orderBy("size")).cast("long")
    return beside.where(~cut).withColumn("nth", F.lit(1).cast("long")).union(beside.where(cut).withColumn("nth", number))


def times(nth=None):
    """How often the mix takes a row that stands beside its source's copies and rules."""
    nth = F.lit(1) if nth is None else F.col(nth)
    fits = F.exists("rules", lambda r: (F.col("hash") >= r["low"]) & (F.col("hash") < r["high"]) & (F.col("size") <= r["most"]) & (nth >= r["first"]) & (nth <= r["last"]))
    return F.col("copies") + fits.cast("long")


def plan(rows: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, int]:
    """The thresholds of all sources of rows(source, size, hash), and the number of sources."""
    goal = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    n = goal.count()
    return written(thresholds(rows, goal, n), "thresholds"), n


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs.

    Empty documents go with their hash like others and cost nothing; a source without words gives none.
    """
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    names = dict(zip(docs.columns, own.columns))
    rows = _sized(own.withColumnsRenamed({names[c]: c for c in ("doc_id", "text", "source")}))
    limits, n = plan(written(rows.select("source", "size", "hash"), "sizes", compact=True), weights, share, most)
    taken = numbered(_beside(rows, limits, n), limits).withColumn("_time", F.explode(F.array_repeat(F.lit(0), times("nth").cast("int"))))
    return taken.select(*[F.col(c if c in ("doc_id", "text", "source") else names[c]).alias(c) for c in docs.columns])


def op5_mixture(spark, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that the mix takes of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows = written(sized(docs).select("doc_id", "source", "size", "hash"), "sizes", compact=True)
    limits, n = plan(rows)
    return numbered(_beside(rows, limits, n), limits).select("doc_id", "size", "source_size", "target", (F.col("size") * times("nth")).alias("taken"))
