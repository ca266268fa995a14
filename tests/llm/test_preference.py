import random

import numpy as np
import pytest

from plenum.llm import preference as P

SCHEMA = "doc_id long, text string"


def sentence(rng):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(4, 12))).capitalize() + "."


def documents(n=600):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        if bad and k % 8:
            text = "BUY NOW!! " * rng.randrange(5, 60)
        elif bad:
            text = " | ".join(sentence(rng)[:8] for _ in range(40))
        else:
            text = "\n".join(sentence(rng) for _ in range(rng.randrange(3, 30)))
        docs.append((k, text))
        labels.append((k, int(not bad)))
    return docs, labels


def test_held_out_accuracy(frame):
    docs, labels = documents()
    wrong = [(k, 1 - q if P_held(k) else q) for k, q in labels]  # labels of the held-out part teach nothing
    rows, _ = P.score_documents(frame(docs, SCHEMA), frame(wrong, "doc_id long, quality int", ()))
    found = {r["doc_id"]: r for r in rows.collect()}
    truth = dict(labels)
    held = [k for k in truth if found[k]["held_out"]]
    assert held == [k for k in truth if P_held(k)] and len(held) > 100
    assert np.mean([(found[k]["score"] >= P.THRESHOLD) == truth[k] for k in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())


def P_held(k):
    import zlib

    return zlib.crc32(str(k).encode()) % 4 == 2


def test_keep(frame):
    docs, labels = documents(300)
    rows = frame(docs + [(None, "x"), (5, ""), (5, None)], SCHEMA)
    kept = P.keep(rows, frame(labels, "doc_id long, quality int", ()))
    assert kept.columns == rows.columns
    ids = {r["doc_id"] for r in kept.collect()}
    good = {k for k, q in labels if q}
    assert len(good - ids) <= 5 and len(ids & {k for k, q in labels if not q}) <= 5


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0)], [(1, 1), (1, 0), (None, 1), (2, None)]])
def test_odd_labels(frame, labels):
    rows, _ = P.score_documents(frame([(1, "a b"), (2, None), (None, "c"), (3, "w " * 30000)], SCHEMA), frame(labels, "doc_id long, quality int", ()))
    scores = [r["score"] for r in rows.collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for s in scores)


def test_loss_by_brute_force():
    """The weights against plain gradient descent on the loss of all pairs."""
    rng = np.random.default_rng(3)
    good, bad = (rng.normal(m, 1, size=(60, 4)).astype(np.float32) for m in ([0.6, 0, -0.3, 0], [0, 0, 0.2, 0]))
    model = P.fit(good, bad, 0.5, l2=0.01)
    a, b = ((x - model.mean) / model.scale for x in (good, bad))
    d = (a[:, None] - b[None]).reshape(-1, 4)
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + 0.005 * w @ w
    w = np.zeros(4)
    for _ in range(3000):
        w -= 0.3 * (-(d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) + 0.01 * w)
    assert loss(w) <= loss(model.weights) <= loss(w) + 2e-3 < loss(np.zeros(4)) - 0.1
    assert model.cut == pytest.approx((P.quantile(np.r_[a @ model.weights, b @ model.weights], np.ones(120), 0.499) + P.quantile(np.r_[a @ model.weights, b @ model.weights], np.ones(120), 0.501)) / 2, abs=1e-4)


def standardised(model, docs, labels):
    """Features of the labelled documents that teach, as the model sees them, and which are good."""
    truth = dict(labels)
    used = [(k, t) for k, t in docs if k in truth and not P_held(k)]
    x = np.vstack([P.rows_of([t.encode()]) for _, t in used]).astype(np.float16).astype(float)
    return x, np.clip((x - model.mean) / model.scale, -8, 8), np.array([truth[k] > 0 for k, _ in used])


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_all_pairs_teach(frame, monkeypatch, most):
    """The loss of all pairs of all labelled documents is as low as the gradient promises, and the cut is of all of them."""
    monkeypatch.setattr(P, "LABELS", most)
    docs, labels = documents(400)
    labels = [(k, 1 - q if k % 17 == 0 else q) for k, q in labels]
    model = P.trained(frame(docs + [(None, "x")], SCHEMA).repartition(5), frame(labels + [(None, 1), (9999, 0)], "doc_id long, quality int", ()))
    raw, x, good = standardised(model, docs, labels)
    assert np.allclose(model.mean, raw.mean(axis=0), atol=1e-4)
    s = x @ model.weights
    lost = 1 / (1 + np.exp(s[good][:, None] - s[~good][None]))
    g = -lost.mean(axis=1) @ x[good] / good.sum() + lost.mean(axis=0) @ x[~good] / (~good).sum() + P.L2 * model.weights
    assert g @ g <= 1.2 * 2 * P.L2 * P.GAP
    share, ones = np.mean(~good), np.ones(len(s))
    assert model.cut == pytest.approx((P.quantile(s, ones, share * (1 - P.EDGE)) + P.quantile(s, ones, share + P.EDGE * (1 - share))) / 2, abs=1e-4)


def test_more_documents_than_a_sample(frame):
    """30,000 labelled documents, of which the last 4,000 alone are long: all are in the means."""
    docs = [(k, "a b" if k < 26_000 else "long " * 30) for k in range(30_000)]
    labels = [(k, int(k % 50 > 0)) for k in range(30_000)]
    model = P.trained(frame(docs, SCHEMA), frame(labels, "doc_id long, quality int", ()))
    used = [k for k in range(30_000) if not P_held(k)]
    share = np.mean([k >= 26_000 for k in used])
    short, long = (float(np.float16(np.log1p(n))) for n in (2, 30))
    assert model.mean[0] == pytest.approx(short + share * (long - short), abs=1e-6)


def test_pair_sums():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 4, (2, 9)).astype(float)
    loss, lost, missed = P.pair_sums(counts, 0.3)
    s, (bad, good) = np.arange(9) * 0.3, counts / counts.sum(axis=1, keepdims=True)
    wins = 1 / (1 + np.exp(-(s[:, None] - s[None])))
    assert loss == pytest.approx(good @ -np.log(wins) @ bad)
    assert np.allclose(lost, [(good * (1 / (1 + np.exp(s - b)))).sum() for b in s]) and np.allclose(missed, [(bad * (1 / (1 + np.exp(g - s)))).sum() for g in s])
    assert [P.number(int(k)) for k in P.ordered(np.array([-2.5, -0.0, 0, 1e-9, 7]))] == pytest.approx([-2.5, 0, 0, 1e-9, 7])
    assert list(np.argsort(P.ordered(np.array([3, -1, 0.5, -9])))) == [3, 1, 2, 0]


def test_hashed_features():
    from collections import Counter

    bodies = [b"", b"A b a  b c", b"one", "é é x".encode() * 50]
    found = P.hashed(bodies)
    assert found.shape == (4, 2 << P.HASH_BITS)
    for body, row in zip(bodies, found):
        ws = body.lower().split()
        assert sorted(np.round(row[: 1 << P.HASH_BITS] ** 2 * len(ws))[row[: 1 << P.HASH_BITS] > 0].tolist()) == sorted(Counter(ws).values())
        assert round(float((row[1 << P.HASH_BITS :] ** 2).sum() * len(ws))) == max(0, len(ws) - 1)
    assert np.array_equal(P.rows_of(bodies[1:3]), np.vstack([P.rows_of([x]) for x in bodies[1:3]]))


def test_features():
    assert P.features(b"") == [0.0] * len(P.NAMES) and len(P.features("Ä b\n\nc".encode())) == len(P.NAMES)
    assert all(np.isfinite(P.features(x)).all() for x in (b"x", b"\xff\xfe", b"a " * 5, b"!!!", b"\n\n"))
