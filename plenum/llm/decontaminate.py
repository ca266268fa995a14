"""Benchmark decontamination with suffix arrays over the training text.

Each shard, a run of whole documents of about SHARD_BYTES, gets a suffix array over its words; every
benchmark suffix is binary-searched in it, and from where they agree the longest verbatim matches are
followed word by word. Hit words, the items found and the documents to remove are read off these matches.
Words are numbered by the benchmark's vocabulary and every other word is 0, which matches nothing, so only
suffixes that start with enough known words to hold a whole window enter the array. Shards are built and
searched where the documents are read: no shuffle.

The benchmark goes to the executors in blocks of about `block_words` words, a bound that does not grow with
it; with more blocks one is made, sent and dropped after another, a table of what is found in between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import written

SHARD_BYTES = 8 << 20
#: Benchmark words in a block, about: 150 MB at the driver and 45 MB in each worker. Matches followed at a time.
BLOCK_WORDS, PAIRS = 250_000, 1 << 20

#: Keeps a-z, 0-9 and all bytes from 0x80, lower-cases A-Z, and makes the rest blank.
LETTERS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words(body: bytes) -> list[bytes]:
    """Maximal runs of letters, digits and non-ASCII characters, A-Z in lower case."""
    return body.translate(LETTERS).split()


class Block:
    """Some benchmark items as numbers, one after another, and their windows, each different one once with its places.

    text has the words' numbers with -1 behind each item; an item begins at first[k] and has windows of least[k] words.
    Window w stands at places[edges[w] : edges[w + 1]].
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        names = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for _, ws in items for w in ws))}
        self.get, self.bits, self.ids = names.get, max(1, len(names).bit_length()), [item for item, _ in items]
        lengths = np.array([len(ws) for _, ws in items], np.int64)
        self.first = np.cumsum(lengths + 1) - lengths - 1
        self.least = np.minimum(lengths, window)
        self.text = np.full(int((lengths + 1).sum()), -1, np.int32)
        for at, (_, ws) in zip(self.first.tolist(), items):
            self.text[at : at + len(ws)] = np.fromiter(map(names.__getitem__, ws), np.int32, len(ws))
        raw, held = self.text.tobytes(), {}
        for at, n, size in zip(self.first.tolist(), lengths.tolist(), self.least.tolist()):
            for q in range(at, at + n - size + 1 if n else at):
                held.setdefault(raw[4 * q : 4 * (q + size)], []).append(q)
        self.sizes = np.array([len(x) // 4 for x in held], np.int64)
        counts = np.array([len(x) for x in held.values()], np.int64)
        self.edges = np.concatenate([[0], np.cumsum(counts)])
        self.places = np.array([q for x in held.values() for q in x], np.int64)
        self.depth, self.shortest = int(self.sizes.max(initial=1)), int(self.sizes.min(initial=1))
        self.low = np.zeros((len(held), self.depth), np.int64)
        self.high = np.full((len(held), self.depth), (1 << self.bits) - 1, np.int64)
        for k, x in enumerate(held):
            self.low[k, : len(x) // 4] = self.high[k, : len(x) // 4] = np.frombuffer(x, np.int32)


def blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[tuple[Block, bool]]:
    """The benchmark in blocks, and whether each is the last; a null text has no words, and a null id stays null."""
    items, held = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    for item, body in rows.toLocalIterator():
        ws = words(bytes(body))
        if items and held + len(ws) > block_words:
            yield Block(items, window), False
            items, held = [], 0
        items.append((item, ws))
        held += len(ws)
    yield Block(items, window), True


def packed(rows: np.ndarray, bits: int) -> list[np.ndarray]:
    """Columns of word numbers, as many to a 63-bit key as fit, in order."""
    each = max(1, 63 // bits)
    keys = []
    for at in range(0, rows.shape[1], each):
        key = np.zeros(len(rows), np.int64)
        for c in range(at, min(at + each, rows.shape[1])):
            key = key << bits | rows[:, c]
        keys.append(key)
    return keys


def bounds(keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """Binary search of all wanted key tuples at once: the first row not below them, or (right) above them."""
    n = len(keys[0])
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), n, np.int64)
    for _ in range(n.bit_length()):
        mid = lo + hi >> 1
        at = np.minimum(mid, n - 1)
        below, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for have, want in zip(keys, wanted):
            below |= equal & (have[at] < want)
            equal &= have[at] == want
        up = (below | equal if right else below) & (lo < hi)
        lo, hi = np.where(up, mid + 1, lo), np.where(up | (lo >= hi), hi, mid)
    return lo


class Shard:
    """A suffix array over the words of some documents, as far as block's windows can match."""

    def __init__(self, texts: list[bytes], block: Block, depth: int):
        get, parts, self.sizes = block.get, [], np.zeros(len(texts), np.int64)
        for k, body in enumerate(texts):
            ws = words(body)
            self.sizes[k] = len(ws)
            ids = np.zeros(len(ws) + 1, np.int32)
            ids[:-1] = np.fromiter(map(get, ws, repeat(0)), np.int32, len(ws))
            parts.append(ids)
        ids = np.concatenate([*parts, np.zeros(depth, np.int32)])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        at = np.arange(len(ids))
        stop = np.minimum.accumulate(np.where(ids == 0, at, len(ids))[::-1])[::-1]
        suffixes = np.flatnonzero(stop - at >= block.shortest)
        rows = ids[suffixes[:, None] + np.arange(depth)].astype(np.int64) if len(suffixes) else np.zeros((0, depth), np.int64)
        rows[np.arange(depth) >= (stop[suffixes] - suffixes)[:, None]] = 0
        keys = packed(rows, block.bits)
        order = np.lexsort(keys[::-1])
        self.suffixes, self.keys, self.n, self.ids = suffixes[order], [k[order] for k in keys], len(ids), ids

    def matches(self, block: Block) -> tuple[np.ndarray, ...]:
        """(document, item, place in the document, place in the item, words) of the longest verbatim matches, which no word on either side extends."""
        none = np.zeros(0, np.int64)
        if not len(self.suffixes) or not len(block.sizes):
            return (none,) * 5
        first, last = bounds(self.keys, packed(block.low, block.bits), False), bounds(self.keys, packed(block.high, block.bits), True)
        parts, met = [], np.flatnonzero(last > first)
        size = (last - first)[met] * np.diff(block.edges)[met]
        for some in np.split(met, np.flatnonzero(np.diff(np.cumsum(size) // PAIRS)) + 1):
            count = (last - first)[some]
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at, window = self.suffixes[np.repeat(first[some], count) + inside], np.repeat(some, count)
            more = np.diff(block.edges)[window]
            inside = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            q, p = block.places[np.repeat(block.edges[window], more) + inside], np.repeat(at, more)
            item = np.searchsorted(block.first, q, side="right") - 1
            begins = (q == block.first[item]) | (p == 0) | (self.ids[p - 1] != block.text[q - 1])
            p, q, item = p[begins], q[begins], item[begins]
            n = block.least[item].copy()
            open_ = np.arange(len(p))
            while len(open_):
                open_ = open_[self.ids[p[open_] + n[open_]] == block.text[q[open_] + n[open_]]]
                n[open_] += 1
            parts.append((p, q, item, n))
        p, q, item, n = (np.concatenate(x) for x in zip(*parts)) if parts else (none,) * 4
        doc = np.searchsorted(self.starts, p, side="right") - 1
        return doc, item, p - self.starts[doc], q - block.first[item], n


def _shards(bodies: list[bytes]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, body in enumerate(bodies):
        if held and held + len(body) > SHARD_BYTES:
            yield start, i
            start, held = i, 0
        held += len(body)
    if start < len(bodies):
        yield start, len(bodies)


FOUND = "array<struct<item: string, doc_start: long, item_start: long, n_words: long>>"


def _bytes(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column, b"").to_pylist()


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, hit, items, matches): what of each document stands in the benchmark.

    matches are the longest verbatim matches of at least a window, `window` consecutive words of an item or a
    whole shorter item: item, places in document and item counted in words from 0, and words. hit is a bitmap
    over the document's words (little-endian bits) and items the sorted ids of the items matched; an item
    without an id hits words and has no name. A null text has no words. Repeated rows and null ids are
    reported each by itself; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"), F.lit(None).cast("binary").alias("hit"), F.array().cast(FOUND).alias("matches"))
    sc = docs.sparkSession.sparkContext
    for block, last in blocks(benchmark, window, block_words):
        shared = sc.broadcast(block)
        rows = rows.mapInArrow(_search(shared, last), f"doc_id {kind}, body binary, hit binary, matches {FOUND}, n_words long, n_hit long")
        if not last:
            rows = written(rows.drop("n_words", "n_hit"), "found")
            shared.destroy()
    items = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item"]), lambda x: x.isNotNull())))
    return rows.select("doc_id", "n_words", "n_hit", "hit", items.alias("items"), "matches")


def _search(shared, last: bool):
    match = pa.struct([("item", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        names = pa.array(block.ids, pa.string())
        for batch in batches:
            bodies, old_hit, old = batch.column("body").to_pylist(), batch.column("hit").to_pylist(), batch.column("matches")
            n_words, n_hit, bitmaps, found = [], [], [], []
            for a, b in _shards(bodies):
                shard = Shard(bodies[a:b], block, block.depth)
                doc, item, at, place, n = shard.matches(block)
                edge = np.zeros(shard.n + 1, np.int64)
                np.add.at(edge, shard.starts[doc] + at, 1)
                np.add.at(edge, shard.starts[doc] + at + n, -1)
                mask = np.cumsum(edge[:-1]) > 0
                order = np.lexsort((place, item, at, doc))
                ends = np.searchsorted(doc[order], np.arange(b - a + 1)).astype(np.int32)
                found.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([names.take(pa.array(item[order])), pa.array(at[order]), pa.array(place[order]), pa.array(n[order])], fields=list(match))))
                for k, size in enumerate(shard.sizes.tolist()):
                    mine, before = mask[shard.starts[k] : shard.starts[k] + size], old_hit[a + k]
                    if before is not None:
                        mine = mine | np.unpackbits(np.frombuffer(before, np.uint8), count=size, bitorder="little").astype(bool)
                    n_words.append(size)
                    n_hit.append(int(mine.sum()))
                    bitmaps.append(np.packbits(mine, bitorder="little").tobytes() if n_hit[-1] else None)
            new = pa.chunked_array(found, pa.list_(match)).combine_chunks()
            if pc.any(pc.greater(pc.list_value_length(old), 0)).as_py():
                new = pa.array([x + y for x, y in zip(old.to_pylist(), new.to_pylist())], pa.list_(match))
            body = pa.nulls(len(bodies), pa.binary()) if last else batch.column("body")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), body, pa.array(bitmaps, pa.binary()), new, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64())], ["doc_id", "body", "hit", "matches", "n_words", "n_hit"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs, all columns as they are, without the rows whose text has a match with the benchmark."""
    sc, at = docs.sparkSession.sparkContext, docs.columns.index("text")

    def keep(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bodies, good = _bytes(batch.column(at)), np.ones(batch.num_rows, bool)
                for a, b in _shards(bodies):
                    good[a + np.unique(Shard(bodies[a:b], shared.value, shared.value.depth).matches(shared.value)[0])] = False
                yield batch.filter(pa.array(good))

        return run

    schema = docs.schema
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    for block, last in blocks(benchmark, window, block_words):
        shared = sc.broadcast(block)
        own = own.mapInArrow(keep(shared), own.schema)
        if not last:
            own = written(own, "kept")
            shared.destroy()
    return own.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(schema.names)])


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, item_start, n_words, doc_id, doc_start): the longest verbatim match of each benchmark suffix.

    Matches shorter than a window (or than a whole shorter item) are left out; of equal lengths the smallest
    doc_id wins, then the smallest place, null before all. Starts count words from 0. Every suffix that
    begins within a match has the rest of it.
    """
    rows = report(docs, benchmark, window, block_words).select("doc_id", F.explode("matches").alias("m"))
    later = F.explode(F.sequence(F.lit(0), F.greatest(F.col("m.n_words") - window, F.lit(0)))).alias("k")
    rows = rows.select("m.item", (F.col("m.item_start")).alias("at"), F.col("m.n_words").alias("n"), "doc_id", F.col("m.doc_start").alias("start"), later)
    best = F.min(F.struct((F.col("k") - F.col("n")).alias("short"), "doc_id", (F.col("start") + F.col("k")).alias("doc_start"))).alias("b")
    out = rows.groupBy(F.col("item").alias("item_id"), (F.col("at") + F.col("k")).alias("item_start")).agg(best)
    return out.select("item_id", "item_start", (-F.col("b.short")).alias("n_words"), "b.doc_id", "b.doc_start")


def digest(items: list[str]) -> str:
    """Lower-case hexadecimal SHA-256 of the ids, comma-joined."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document with its words, hit words and the items found in it."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = report(docs, bench)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE = {
    "op1_decontaminate": f"""
with d as (select doc_id, {_WORDS} as ws from documents),
b as (select item_id, {_WORDS} as ws from benchmark),
bw as (select distinct item_id, least(len(ws), 10) as n, array_to_string(list_slice(ws, p, p + least(len(ws), 10) - 1), ' ') as w
       from (select item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) as p from b where len(ws) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, p, n, array_to_string(list_slice(ws, p, p + n - 1), ' ') as w
       from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as p from d, sizes where len(ws) >= n)),
found as (select distinct doc_id, p, dw.n, item_id from dw join bw using (w)),
hit as (select doc_id, count(distinct i) as n_hit from (select doc_id, unnest(range(p, p + n)) as i from found) group by doc_id),
ids as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join ids using (doc_id)"""
}
