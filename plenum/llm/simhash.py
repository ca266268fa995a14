"""SimHash near-duplicates, compared bit-sliced.

Fingerprints that differ in at most `radius` bits are linked. The 64 bits are cut into `blocks` blocks;
two such fingerprints agree in at least blocks - radius of them, so fingerprints that agree in no choice
of that many blocks are never compared, and none that should be is missed. Within a bucket the distances
are counted in vertical layout: word i of a plane holds bit i of 64 lanes, a carry-save counter adds the
difference planes, and a block of lanes is abandoned when every lane has passed the radius.

A bucket of any size is dealt to several tasks: it is cut into chunks by hash, and each pair of chunks is
one unit of work, which returns a spanning forest and not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plenum.llm.common import as_bytes, bodies, written
from plenum.llm.components import connected_components

SHINGLE_BLOCK = 1 << 16


def fingerprint(body: bytes, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text: bit i is set where over half of its shingles' XXH64 have it; 0 without words."""
    words = body.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(line, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: 1 - width or None].tolist(), ends[width - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(last), SHINGLE_BLOCK):
        part = [digest(line[a:b], seed) for a, b in zip(first[at : at + SHINGLE_BLOCK], last[at : at + SHINGLE_BLOCK])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(last), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in bodies(batches):
            found = np.array([fingerprint(x, width, seed) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([keys, pa.array(found)], ["doc_id", "fp"])

    rows = as_bytes(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def keep_one(docs: DataFrame, radius: int = 3) -> DataFrame:
    """docs, all columns as they are, with the document of the smallest doc_id from each component.

    Rows without a doc_id are kept. Of rows that repeat a doc_id within a component one stays: those with
    different texts are told apart by a hash of the text.
    """
    marked = docs.select(F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).alias("doc_id"), "text")
    found = classes(written(fingerprints(marked), "prints", compact=True), radius).select("doc_id.doc_id", "doc_id.h", F.col("component_id.doc_id").alias("c_id"), F.col("component_id.h").alias("c_h"))
    found = written(found.where("doc_id is not null"), "classes")
    gone = found.where("doc_id <> c_id or h <> c_h").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    kept = docs.join(gone, (docs["doc_id"] == gone["_id"]) & (own == gone["_h"]), "left_anti")
    if found.where("doc_id = c_id and h = c_h").groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        return kept
    place = next(c for c in (f"_n{k}" for k in range(len(docs.columns) + 1)) if c not in docs.columns)
    numbered = kept.withColumn(place, F.row_number().over(Window.partitionBy("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy(F.lit(0))))
    return numbered.where(F.col("doc_id").isNull() | (F.col(place) == 1)).drop(place)


def planes(values: np.ndarray) -> np.ndarray:
    """uint64[n] -> uint64[64, ceil(n / 64)]: bit i of every value, 64 values to a word."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, "<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(difference, shape: tuple, radius: int) -> np.ndarray:
    """Lanes whose difference planes have at most `radius` bits set, as words of that shape.

    difference(i) gives plane i. The counter starts so high that its carry out means "over the radius".
    """
    width = radius.bit_length()
    start = (1 << width) - 1 - radius
    counter = [np.full(shape, np.uint64(0xFFFFFFFFFFFFFFFF if start >> k & 1 else 0)) for k in range(width)]
    over = np.zeros(shape, np.uint64)
    for i in range(64):
        carry = difference(i)
        for k in range(width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if i % 8 == 7 and (over == np.uint64(0xFFFFFFFFFFFFFFFF)).all():
            break
    return ~over


def lanes(words: np.ndarray, n: int) -> np.ndarray:
    """The n lanes of packed words as booleans, along the last axis."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within a (b is None) or between a and b, as two arrays of ends."""
    nodes = a if b is None else np.concatenate([a, b])
    label, off = np.arange(len(nodes)), 0 if b is None else len(a)
    other = a if b is None else b
    vertical = planes(other)
    for at in range(0, len(a), 64):
        part = a[at : at + 64]
        mask = [np.where(part >> np.uint64(i) & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None] for i in range(64)]
        near = lanes(within(lambda i, m=mask: vertical[i][None, :] ^ m[i], (len(part), vertical.shape[1]), radius), len(other))
        for k in np.flatnonzero(near.sum(axis=1) > (b is None)):
            members = np.append(np.flatnonzero(near[k]) + off, at + k)
            own = label[members]
            if (own != own[0]).any():
                found = np.unique(own)
                label[np.isin(label, found[1:])] = found[0]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _small(groups: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within many small groups at once: one lane for each pair of a group."""
    left, right = [], []
    for g in groups:
        i, j = np.triu_indices(len(g), 1)
        left.append(g[i])
        right.append(g[j])
    x, y = np.concatenate(left), np.concatenate(right)
    px, py = planes(x), planes(y)
    near = lanes(within(lambda i: px[i] ^ py[i], px.shape[1:], radius), len(x))
    return x[near], y[near]


def bucket_links(buckets: DataFrame, radius: int = 3, small: int = 12) -> DataFrame:
    """(unit, side, fp), the rows of a unit together in a partition, sorted -> edges (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, sides, pending, n = None, [], [], [], 0

        def out(u, v):
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        def close():
            nonlocal pending, n
            if held:
                fp, side = np.concatenate(held), np.concatenate(sides)
                if not side.any() and len(fp) <= small:
                    if len(fp) > 1:
                        pending.append(fp)
                        n += len(fp) ** 2 // 2
                else:
                    a, b = fp[side == 0], fp[side == 1]
                    if side.any():
                        if len(a):
                            yield out(*forest(a, b, radius))
                    else:
                        yield out(*forest(a, None, radius))
            if pending and (n > 200_000 or unit is None):
                yield out(*_small(pending, radius))
                pending, n = [], 0

        for batch in batches:
            key = batch.column("key").to_numpy(), batch.column("i").to_numpy(), batch.column("j").to_numpy()
            side, fp = batch.column("side").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            cuts = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
                if s == e:
                    continue
                now = (int(key[0][s]), int(key[1][s]), int(key[2][s]))
                if now != unit:
                    yield from close()
                    unit, held, sides = now, [], []
                held.append(fp[s:e].copy())
                sides.append(side[s:e].copy())
        yield from close()
        held, unit = [], None
        yield from close()

    return buckets.mapInArrow(run, "u long, v long")


def links(distinct: DataFrame, radius: int = 3, blocks: int = 5, chunk: int = 4096) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (u, v) whose components are those of all links within the radius.

    A bucket key is a choice of blocks - radius blocks and their bits. More blocks make longer keys and so
    smaller buckets, and more keys a fingerprint: 5 give 10 keys of about 26 bits, 6 give 20 of 32.
    """
    if not 0 < radius < blocks:
        raise ValueError("radius must be above 0 and below blocks")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.col("fp").bitwiseAND(F.lit(mask)), F.lit(n)))
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    # a table of its own, so that a key with very many fingerprints can be split in the join
    sizes = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes", compact=True)
    parts = keyed.join(sizes, "key").select("key", "fp", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    parts = parts.withColumn("part", F.pmod(F.xxhash64("fp", F.lit("part")), "parts").cast("int"))
    units = parts.select("key", "fp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    units = units.select("key", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), (F.col("part") > F.col("with")).cast("int").alias("side"), "fp")
    units = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return bucket_links(units, radius).distinct()


def classes(prints: DataFrame, radius: int = 3, blocks: int = 5, chunk: int = 4096) -> DataFrame:
    """(doc_id, fp) -> (doc_id, fp, component_id): component_id is the smallest doc_id reachable by links.

    Equal fingerprints are one node, so any number of copies costs one row in the comparison. Rows without
    a doc_id take part; a component of such rows alone has a null component_id. Repeated rows stay.
    """
    key = "doc_id.doc_id" if isinstance(prints.schema["doc_id"].dataType, StructType) else "doc_id"
    nodes = written(prints.groupBy("fp").agg(F.min(F.when(F.col(key).isNotNull(), F.col("doc_id"))).alias("least")), "fingerprints")
    roots = connected_components(links(nodes.select("fp"), radius, blocks, chunk)).select(F.col("node").alias("fp"), "root")
    tied = written(nodes.join(roots, "fp"), "tied", compact=True)
    # tables of their own, so that a component or a fingerprint of very many documents can be split in the joins
    roots = written(tied.groupBy("root").agg(F.min("least").alias("label")), "roots", compact=True)
    labels = tied.select("fp", "root").join(roots, "root").select("fp", "label")
    named = nodes.join(labels, "fp", "left").select("fp", F.coalesce("label", "least").alias("component_id"))
    return prints.join(written(named, "named", compact=True), "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint in hexadecimal and its component."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = written(fingerprints(docs), "prints", compact=True)
    return classes(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
