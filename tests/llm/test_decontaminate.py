import hashlib
import random

import pytest

from plenum.llm import decontaminate as D

SCHEMA = "doc_id long, text string"


def brute(docs, items, window=10):
    """Every window of every item, looked for at every word."""
    out = {}
    for doc_id, text in docs:
        ws = D.words((text or "").encode())
        hit, found = set(), set()
        for item_id, item in items:
            its = D.words((item or "").encode())
            n = min(window, len(its))
            for a in range(len(its) - n + 1 if n else 0):
                for p in range(len(ws) - n + 1):
                    if ws[p : p + n] == its[a : a + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item_id))
        out.setdefault(doc_id, []).append((len(ws), len(hit), sorted(found)))
    return out


def cases():
    rng = random.Random(3)
    words = ["Alpha", "b", "c,", "d-e", "é", "f.", "g1", "zz"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for k in range(14)] + [(14, None), (9, "twice b c"), (100, "!!"), (None, "null item words")]
    docs = []
    for k in range(60):
        parts = [" ".join(rng.choice(words + ["other"]) for _ in range(rng.randrange(30)))]
        if k % 3 == 0:
            parts.append(rng.choice(items)[1] or "")
        docs.append((k, " ".join(parts).upper() if k % 5 == 0 else " ".join(parts)))
    return docs + [(60, None), (61, ""), (62, "?!"), (63, "alpha " * 30000), (None, "null item words here"), (5, "b b b"), (5, "b b b")], items


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_report_is_brute_force(frame, block_words):
    docs, items = cases()
    expected = brute(docs, items)
    found = {}
    for r in D.report(frame(docs, SCHEMA), frame(items, "item_id long, text string"), block_words=block_words).collect():
        found.setdefault(r["doc_id"], []).append((r["n_words"], r["n_hit"], [x for x in r["items"]]))
    clean = lambda rows: sorted((n, h, sorted(i)) for n, h, i in rows)
    assert {k: clean(v) for k, v in found.items()} == {k: clean([(n, h, [x for x in i if x != "None"]) for n, h, i in v]) for k, v in expected.items()}


def test_clean_keeps_columns(frame):
    docs, items = cases()
    items = [(i, t) for i, t in items if len(D.words((t or "").encode())) >= 10]
    rows = frame(docs, SCHEMA)
    kept = D.clean(rows, frame(items, "item_id long, text string"))
    assert kept.schema == rows.schema
    good = [(k, t) for k, t in docs if brute([(k, t)], items)[k][0][1] == 0]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(good, key=str)


def test_empty_tables(frame):
    docs, none = frame([(1, "a b")], SCHEMA), frame([], "item_id long, text string")
    assert [(r["n_words"], r["n_hit"]) for r in D.report(docs, none).collect()] == [(2, 0)]
    assert D.report(frame([], SCHEMA), none).count() == 0 and D.clean(docs, none).count() == 1


def test_longest_matches(frame):
    item = "a1 a2 a3 a4 a5 a6"
    docs = [(1, "x a2 a3 a4 y"), (2, "a2 a3 a4 a5 z a1 a2"), (3, "a9")]
    rows = D.longest_matches(frame(docs, SCHEMA), frame([(7, item)], "item_id long, text string"), window=3).collect()
    assert sorted((r["item_id"], r["item_start"], r["n_words"], r["doc_id"], r["doc_start"]) for r in rows) == [("7", 1, 4, 2, 0), ("7", 2, 3, 2, 1)]


def test_digest():
    assert D.digest(["1", "10", "2"]) == hashlib.sha256(b"1,10,2").hexdigest()


def test_long_items(frame, monkeypatch):
    rng = random.Random(9)
    item = [f"t{rng.randrange(5)}" for _ in range(300)]
    docs = [(k, " ".join(["x", *item[a:b], "y"])) for k, (a, b) in enumerate([(0, 300), (10, 150), (100, 299), (0, 80)])] + [(9, " ".join(rng.choice(item) for _ in range(500)))]
    expected = {}
    for at in range(300):
        best = (0,)
        for doc_id, text in docs:
            ws = text.split()
            for p in range(len(ws)):
                n = 0
                while at + n < 300 and p + n < len(ws) and ws[p + n] == item[at + n]:
                    n += 1
                best = max(best, (n, -doc_id))
        if best[0] >= 10:
            expected[at] = (best[0], -best[1])
    for pairs in (1 << 20, 3):
        monkeypatch.setattr(D, "PAIRS", pairs)
        rows = D.longest_matches(frame(docs, SCHEMA).coalesce(1), frame([(1, " ".join(item))], "item_id long, text string")).collect()
        assert {r["item_start"]: (r["n_words"], r["doc_id"]) for r in rows} == expected


def test_matches_and_text_ids(spark):
    """Each match as it stands in both texts, and extended by no word; ids that are no numbers."""
    docs, items = cases()
    docs = [(f"d{k}", t) for k, (_, t) in enumerate(docs)]
    rows = D.report(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([(f"i{k}", t) for k, (_, t) in enumerate(items)], "item_id string, text string")).collect()
    text = {d: D.words((t or "").encode()) for d, t in docs}
    item = {f"i{k}": D.words((t or "").encode()) for k, (_, t) in enumerate(items)}
    seen = 0
    for r in rows:
        ws, hit = text[r["doc_id"]], set()
        assert len({tuple(m) for m in r["matches"]}) == len(r["matches"])
        for m in r["matches"]:
            its, a, b, n = item[m["item"]], m["doc_start"], m["item_start"], m["n_words"]
            assert ws[a : a + n] == its[b : b + n] and n >= min(10, len(its))
            assert a == 0 or b == 0 or ws[a - 1] != its[b - 1]
            assert a + n == len(ws) or b + n == len(its) or ws[a + n] != its[b + n]
            hit |= set(range(a, a + n))
            seen += 1
        assert len(hit) == r["n_hit"]
    assert seen > 20
    best = D.longest_matches(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([("i", items[11][1] or "b c d e f g h i j k")], "item_id string, text string"))
    assert dict(best.dtypes)["doc_id"] == "string" and best.count() >= 0
