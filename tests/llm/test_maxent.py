import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.llm import maxent as M

SCHEMA = "doc_id long, text string"
END = object()


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    rows = []
    for k in range(300):
        a, b = (["red", "green,", "blue."], ["uno", "dos", "tres,"]) if k % 2 else (["eins", "zwei", "drei"], ["x", "y", "z"])
        words = [w for _ in range(rng.randrange(30)) for w in (rng.choice(a), rng.choice(b))] + [f"rare{rng.randrange(400)}"]
        rows.append((k, " ".join(words)))
    return rows + [(300, None), (301, ""), (302, "\x00end \x0b QQ"), (None, "red uno"), (5, "red red"), (5, "red red"), (303, "y" * 3000 + " y" * 3000)]


def scored(frame, rows, hot, monkeypatch):
    monkeypatch.setattr(M, "HOT", hot)
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return M.score_documents(frame(rows, SCHEMA), out).collect()


@pytest.mark.parametrize("hot", [200_000, 10])
def test_counts_and_base(frame, docs, hot, monkeypatch):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, t in docs if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(d), held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for d, t in docs)
    found = scored(frame, docs, hot, monkeypatch)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == expected


def test_model_is_better_than_counts(frame, docs, monkeypatch):
    rows = [r for r in scored(frame, docs, 200_000, monkeypatch) if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


class Plain:
    """The model's probabilities word by word, from its weights and plain counts of words."""

    def __init__(self, words, tables, counts):
        self.words, self.tables, self.counts, self.hot = words, tables, counts, {w: k for k, w in enumerate(words.hot)}
        self.bits = len(tables[0]).bit_length() - 1

    def own(self, word):
        return int(M.hashes(*M.cut([word])[:3])[0])

    def place(self, word):
        if word is END:
            return 0, -1
        if word in self.hot:
            return int(self.words.hot_class[self.hot[word]]), int(self.words.hot_inner[self.hot[word]])
        return 1 + M.SINGLES + int(self.words.groups[M.ending(word)]), M.TOP + (self.own(word) >> 40) % M.BINS

    def row(self, key, k):
        mask = (1 << 64) - 1
        key = (key + (k + 1) * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & mask
        return ((key ^ key >> 31) * 0x94D049BB133111EB & mask) >> 64 - self.bits

    def softmax(self, z):
        z = [min(x, 60.0) for x in z]
        total = sum(math.exp(x) for x in z)
        return [math.exp(x) / total for x in z]

    def chance(self, before, word):
        """The probability of a word, None for one never seen, after those before it."""
        back = [self.own(before[-k]) if len(before) >= k else int(M.BEFORE) for k in (1, 2, 3)]
        kinds = [self.place(before[-k])[0] + 1 if len(before) >= k else 0 for k in (1, 2)]
        keys = [back[0], kinds[0] * 997 + kinds[1], back[1], back[2]]
        z = sum(self.tables[0][self.row(key, k)].astype(float) for k, key in enumerate(keys)) + [math.log(x) for x in self.words.share]
        classes = self.softmax(z)
        c, inner = self.place(word)
        if inner < 0:
            return classes[c]
        own = (c + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1
        z = sum(self.tables[1][self.row(key ^ own, 4 + k)].astype(float) for k, key in enumerate(back[:2])) + [math.log(x) for x in self.words.inner_share[c]]
        inside = self.softmax(z)[inner]
        if inner < M.TOP:
            return classes[c] * inside
        mates = [n for w, n in self.counts.items() if w is not END and self.place(w) == (c, inner)]
        return classes[c] * inside * (self.counts.get(word, 0) + 1) / (sum(mates) + len(mates) + 1)


@pytest.mark.parametrize("hot", [200_000, 60])
def test_score_by_brute_force(frame, spark, docs, hot, monkeypatch):
    monkeypatch.setattr(M, "HOT", hot)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts, kept = Counter(w for d, t in docs if not held(d) for w in tokens(t)), []
    trained = M.trained

    def once(rows, words, n):
        kept.append((words, trained(rows, words, n)))
        return kept[-1][1]

    monkeypatch.setattr(M, "trained", once)
    found = scored(frame, docs, hot, monkeypatch)
    plain = Plain(*kept[0], counts)
    assert any(np.abs(t).max() > 0.1 for t in plain.tables[:1]) and np.abs(plain.tables[1]).max() > 0.1
    texts = {}
    for d, t in docs:
        texts.setdefault(d, []).append(t)
    checked = 0
    for r in found:
        options = [sum(math.log10(plain.chance(ws[:k], ws[k])) for k in range(len(ws))) for ws in map(tokens, texts[r["doc_id"]])] if r["doc_id"] is None or r["doc_id"] % 7 == 0 or r["doc_id"] > 299 else None
        if options is not None:
            assert any(r["score"] == pytest.approx(x, abs=1e-3, rel=1e-5) for x in options)
            checked += 1
    assert checked > 40


def test_probabilities_sum_to_one(frame, docs, monkeypatch):
    monkeypatch.setattr(M, "HOT", 40)
    rows = frame(docs, SCHEMA).select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"))
    counts, profile, ends = M.counted(rows)
    words, n, v = M.vocabulary(counts, M.grouped(profile), ends)
    known = Counter(w for _, t in docs for w in tokens(t))
    assert (n, v) == (sum(known.values()), len(known))
    rng = np.random.default_rng(0)
    tables = [rng.normal(size=(1 << 10, width)).astype(np.float32) for width in (M.CLASSES, M.INNER)]
    plain = Plain(words, tables, known)
    unseen, k = {}, 0
    while len(unseen) < M.GROUPS * M.BINS:  # one place in each bin, whatever its word
        word, k = f"q{k * 7919 % 46656:o}".encode(), k + 1
        unseen.setdefault(plain.place(word), word)
    for before in ([], [b"red"], [b"uno", b"rare7"], [b"eins", b"x", b"zwei"]):
        assert sum(plain.chance(before, w) for w in [*known, *unseen.values()]) == pytest.approx(1, abs=1e-4)


def test_updates_are_averaged_in_a_tree(spark):
    rng, rows, total = np.random.default_rng(1), [], {}
    for shard in range(200):
        for block, width in ((0, 3), (5, 2)):
            met, delta = rng.integers(0, 4, M.BLOCK).astype(np.float32), rng.normal(size=(M.BLOCK, width)).astype(np.float32)
            rows.append((block, shard, met.tobytes(), (delta * met[:, None]).tobytes()))
            n, d = total.get(block, (0, 0))
            total[block] = n + met, d + delta * met[:, None]
    found = M.averaged(spark.createDataFrame(rows, "block int, shard long, met binary, delta binary"), 200, True).collect()
    assert sorted(r["block"] for r in found) == [0, 5]
    for r in found:
        n, d = total[r["block"]]
        assert np.allclose(np.frombuffer(r["delta"], np.float32).reshape(M.BLOCK, -1), d / np.maximum(n, 1)[:, None], atol=1e-4)


def test_rows_grow():
    assert [M.row_bits(n) for n in (0, 1, M.TOKENS, M.TOKENS + 1, 4 * M.TOKENS + 1, 10**15)] == [15, 15, 15, 16, 17, 18]


def test_cut_and_hash():
    texts = [b"", b" A b\tC\x0bd ", "É é".encode(), b"x" * 700 + b" .,;", b"same same"]
    low, starts, sizes, counts = M.cut(texts)
    words = [low[a : a + n].tobytes() for a, n in zip(starts, sizes)]
    assert words == [w for t in texts for w in t.lower().split()] and list(counts) == [len(t.split()) for t in texts]
    assert list(M.endings(low, starts, sizes)) == [M.ending(w) for w in words]
    own = M.hashes(low, starts, sizes)
    assert len(set(own.tolist())) == len(set(words)) and own[-1] == own[-2]
    alone = M.hashes(*M.cut([words[2]])[:3])
    assert alone[0] == own[2]


def test_no_training(frame):
    out = F.lit(True)
    (row,) = M.score_documents(frame([(1, "a b")], SCHEMA), out).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and row["base_score"] == 0.0
    assert M.score_documents(frame([], SCHEMA), F.lit(False)).count() == 0
