import re

import pytest
from pyspark.sql import functions as F

from plenum.llm import mixture as M

SCHEMA = "doc_id long, text string, source string"


def level(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture
def docs(frame):
    rows = [(k, "w " * (1 + k % 9), ["a", "b", "ä", None, "Z", "huge"][min(5, k % 8)]) for k in range(800)] + [(900, None, "none"), (901, "", "none"), (None, "x y", "a"), (3, "x y z", "a"), (3, "x y z", "a"), (902, "  \x0bq", "b")]
    return rows, frame(rows, SCHEMA)


def test_plan(docs):
    rows, df = docs
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + count(text)
    goal = level(sizes)
    limits, n = M.plan(M.sized(df).select("source", "size", "hash"))
    assert n == len(sizes)
    found = {r["source"]: r for r in limits.collect()}
    assert {s: r["target"] for s, r in found.items()} == pytest.approx(goal)
    assert {s: r["source_size"] for s, r in found.items()} == sizes
    taken = {}
    for r in M._beside(M.sized(df).select("doc_id", "source", "size", "hash"), limits, n).withColumn("times", M.times()).collect():
        assert 0 <= r["times"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["times"] * r["size"]
    for s, goal_ in goal.items():
        assert abs(taken[s] - goal_) <= 2


def test_large_documents(frame):
    rows = [(k, "w " * (4000 if k % 10 == 0 else 1 + k % 30), "abc"[k % 3]) for k in range(300)]
    df = frame(rows, SCHEMA)
    limits, n = M.plan(M.sized(df).select("source", "size", "hash"))
    found = M._beside(M.sized(df), limits, n).groupBy("source").agg(F.sum(F.col("size") * M.times()).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 2000 for r in found)


def test_mix(docs):
    rows, df = docs
    mixed = M.mix(df)
    assert mixed.columns == df.columns
    assert mixed.exceptAll(M.mix(df)).count() == 0
    words = sum(count(r["text"]) for r in mixed.select("text").collect())
    assert abs(words - 1.5 * sum(count(t) for _, t, _ in rows)) < 60


def test_edges(frame):
    assert M.mix(frame([], SCHEMA)).count() == 0
    assert {r["doc_id"] for r in M.mix(frame([(1, None, "a"), (2, "", "b")], SCHEMA)).collect()} <= {1, 2}
    only = M.mix(frame([(1, "a b c", None)], SCHEMA)).count()
    assert only in (1, 2)


def test_native(docs):
    rows, df = docs
    plan = M.mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_rows_that_repeat(frame):
    # 1000 equal rows of 100 words, and others of less; in b and None nothing else
    rows = [(None, "w " * 100, "a")] * 1000 + [(k, "w " * (1 + k % 60), "a") for k in range(300)] + [(7, "w " * 50, "b")] * 300 + [(None, "w " * 30, None)] * 101
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + count(text)
    for share in (0.31, 0.777, 1.13):
        goal = level(sizes, share=share)
        taken = {s: 0 for s in sizes}
        for r in M.mix(frame(rows, SCHEMA), share=share).collect():
            taken[r["source"]] += count(r["text"])
        assert abs(taken["a"] - goal["a"]) <= 30 and abs(taken["b"] - goal["b"]) <= 25 and abs(taken[None] - goal[None]) <= 15


def test_filled_until_nothing_smaller_is_left(frame):
    # sizes that shrink by a third as the hash grows: each round is stopped by the next document
    df = M.sized(frame([(k, "w", "a") for k in range(40)], SCHEMA)).orderBy("hash").limit(30)
    own = sorted(r["hash"] for r in df.collect())
    sizes = [int(4 * 1.5 ** (29 - k)) for k in range(30)]
    rows = df.sparkSession.createDataFrame([("a", s, h) for s, h in zip(sizes, own)], "source string, size long, hash long")
    left, want = 0.6 * sum(sizes), 0
    for s in sizes:
        want += s if s <= left - want else 0
    limits, n = M.plan(rows, share=0.6)
    found = M._beside(rows, limits, n).agg(F.sum(F.col("size") * M.times()).alias("taken"), F.first("target").alias("target")).first()
    assert found["target"] == pytest.approx(left)
    assert abs(found["taken"] - left) <= abs(want - left)
