import zlib

import numpy as np
import pyarrow as pa
import pytest

from plenum.llm import token_stream as T

SCHEMA = "doc_id long, text string"
TEXTS = [None, "", "Hello, World!", "ends with # and #", "<|endoftext|> A<|ENDOFTEXT|>", "ΑΣ İstanbul É éx ſ K don't 12", "日本語 🎉", "a\x01b", "word " * 20000, "same", "same"]


@pytest.fixture(scope="module")
def tokenizer():
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.default_tokenizer())


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_encoder(tokenizer):
    encoder = T.Encoder(T.default_tokenizer())
    bodies = [(t or "").encode() for t in TEXTS]
    for _ in range(2):
        assert [list(np.frombuffer(x, encoder.dtype)) for x in encoder.encode(bodies)] == [ids(tokenizer, t)[:-1] for t in TEXTS]
    whole = T.Encoder(T.default_tokenizer(), by_word=False)
    assert encoder.encode(bodies) == whole.encode(bodies)
    assert list(encoder._words([b"one", b"two"])) == [np.array(ids(tokenizer, w)[:-1], "<u2").tobytes() for w in ("one", "two")]


def test_round_trip(frame, spark, tokenizer, tmp_path):
    docs = [(50 - 3 * k if k % 4 else 7, t) for k, t in enumerate(TEXTS)] + [(None, "no id")]
    out = str(tmp_path / "files")
    T.write_tokens(frame(docs, SCHEMA), T.default_tokenizer(), out, sequence=16, rows=4, file_ids=500)
    rows = T.read_documents(spark, out).orderBy("start").collect()
    keys = [r["doc_id"] for r in rows]
    assert keys == sorted(keys, key=lambda x: (x is not None, x or 0)) and len(rows) == len(docs)
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    crc = lambda t: (len(ids(tokenizer, t)), zlib.crc32(np.array(ids(tokenizer, t), "<u4").tobytes()))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=str) == sorted(((d, *crc(t)) for d, t in docs), key=str)


def test_random_access(frame, spark, tokenizer, tmp_path):
    out = tmp_path / "files"
    T.write_tokens(frame(list(enumerate(TEXTS)), SCHEMA).coalesce(1), T.default_tokenizer(), str(out), sequence=16, rows=4)
    seen = 0
    for path in sorted(out.glob("part-*")):
        file = T.SequenceFile(str(path))
        total = np.concatenate([file.ids(i)[file.mask(i).to_numpy(zero_copy_only=False)] for i in range(len(file))])
        for doc, start, n in zip(*(c.to_pylist() for c in file.documents().columns)):
            assert list(total[start : start + n]) == ids(tokenizer, TEXTS[doc]) == list(file.span(start, n))
            seen += 1
        assert all(len(file.ids(i)) == 16 == len(file.mask(i)) for i in range(len(file)))
        before = pa.total_allocated_bytes()
        [file.ids(i) for i in range(len(file))]
        assert pa.total_allocated_bytes() == before
    assert seen == len(TEXTS)


def test_empty(frame, tokenizer):
    assert T.token_rows(frame([], SCHEMA)).count() == 0


def test_small_memory(tokenizer, monkeypatch):
    import random

    monkeypatch.setattr(T, "BYTES", 60)
    monkeypatch.setattr(T, "CACHED_WORDS", 40)
    encoder, rng = T.Encoder(T.default_tokenizer()), random.Random(1)
    for k in range(30):
        bodies = [" ".join(f"w{rng.randrange(30 + 20 * k)}é" for _ in range(rng.randrange(80))) for _ in range(5)] + ["x\n" * 200, "y" * 500 + " z"]
        assert [list(np.frombuffer(x, encoder.dtype)) for x in encoder.encode([b.encode() for b in bodies])] == [ids(tokenizer, b)[:-1] for b in bodies]


def test_parts():
    for body in (b"", b"abc", b"a b c d e f", b"abcdefgh ij\tk", b" " * 9):
        for most in (1, 3, 5):
            pieces = list(T.parts(body, most))
            assert b"".join(pieces) == body and [w for p in pieces for w in p.split()] == body.split()


def test_words_that_share_a_hash(tokenizer, monkeypatch):
    from plenum.llm import words as W

    weak = lambda low, starts, sizes: sizes.astype(np.uint64) % np.uint64(3) << np.uint64(62)
    monkeypatch.setattr(T, "hashes", weak)
    encoder = T.Encoder(T.default_tokenizer())
    bodies = [b"one two six four five one", b"ten two " + b"q" * 400 + b" " + b"r" * 400, b"one six ten nine five"]
    for _ in range(3):
        assert [list(np.frombuffer(x, encoder.dtype)) for x in encoder.encode(bodies)] == [ids(tokenizer, b.decode())[:-1] for b in bodies]
    low, starts, sizes, _ = W.cut(bodies)
    first, place = W.distinct(low, starts, sizes, weak(low, starts, sizes))
    every = [low[a : a + n].tobytes() for a, n in zip(starts, sizes)]
    assert [every[k] for k in first[place]] == every and len(first) == len(set(every)) and all(every.index(every[k]) == k for k in first)


def test_bases(spark):
    rows = [(p, f, (p * 7 + f) % 5) for p in (0, 1, 3, 8, 9, 40) for f in range(p % 3 + 1)]
    found = {(r["part"], r["file"]): r["base"] for r in T.bases(spark.createDataFrame(rows, "part long, file long, n_ids long"), 4).collect()}
    at, expected = 0, {}
    for p, f, n in sorted(rows):
        expected[p, f] = at
        at += n
    assert found == expected
