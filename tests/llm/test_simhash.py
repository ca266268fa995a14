import random

import numpy as np
import pytest
import xxhash

from plenum.llm import simhash as S

SCHEMA = "doc_id long, text string"


def plain(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(prints, radius=3):
    """Components of (doc_id, fp) by comparing all pairs; the smallest id that is not null."""
    group = list(range(len(prints)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                group[top(i)] = top(j)
    ids = {}
    for k, (doc, _) in enumerate(prints):
        ids.setdefault(top(k), []).append(doc)
    return [(doc, min((x for x in ids[top(k)] if x is not None), default=None)) for k, (doc, _) in enumerate(prints)]


TEXTS = [None, "", " \n\t ", "one", "One Two", "a b c", "A\tB\x0bC d", "é ü ß", "same words here again and again " * 400, "x" * 5000, "a b c d"]


def test_fingerprints(frame):
    rows = frame(list(enumerate(TEXTS)), SCHEMA)
    found = {r["doc_id"]: r["fp"] & 0xFFFFFFFFFFFFFFFF for r in S.fingerprints(rows).collect()}
    assert found == {k: plain(t) for k, t in enumerate(TEXTS)}


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a b c",), ("é",)], "s string")
    assert [r[0] & 0xFFFFFFFFFFFFFFFF for r in df.select(F.xxhash64("s")).collect()] == [xxhash.xxh64_intdigest(s.encode(), 42) for s in ("a b c", "é")]


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 5])
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 1 << 63, 130, dtype=np.uint64)
    b = a ^ np.uint64(1) << rng.integers(0, 64, 130).astype(np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, 130).astype(np.uint64)) ^ (rng.integers(0, 1 << 8, 130).astype(np.uint64))
    pa, pb = S.planes(a), S.planes(b)
    near = S.lanes(S.within(lambda i: pa[i] ^ pb[i], pa.shape[1:], radius), 130)
    assert (near == (np.bitwise_count(a ^ b) <= radius)).all()


@pytest.mark.parametrize("chunk", [4096, 8])
def test_classes_are_brute_force(spark, chunk):
    rng = random.Random(5)
    prints = []
    for k in range(300):
        base = rng.choice(prints)[1] if prints and rng.random() < 0.6 else rng.getrandbits(64)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            base ^= 1 << rng.randrange(64)
        prints.append((k if k % 17 else None, base))
    prints += [(5, prints[7][1]), (5, prints[7][1]), (None, rng.getrandbits(64))]
    signed = [(d, f - (1 << 64) if f >> 63 else f) for d, f in prints]
    found = S.classes(spark.createDataFrame(signed, "doc_id long, fp long"), chunk=chunk)
    assert sorted(((r["doc_id"], r["component_id"]) for r in found.collect()), key=str) == sorted(roots(prints), key=str)


def test_keep_one(frame):
    text = " ".join(f"word{k}" for k in range(200))
    rows = frame([(4, text), (2, text + " more"), (2, text + " more"), (9, "another"), (9, "quite different"), (None, text), (11, None), (12, "")], SCHEMA)
    kept = S.keep_one(rows)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(2, text + " more"), (9, "another"), (9, "quite different"), (None, text), (11, None)], key=str)
    assert kept.columns == rows.columns
    assert S.keep_one(frame([], SCHEMA)).count() == 0
