import zlib

import numpy as np
import pytest
from support import DATA

import corpus_pipeline as C
from plenum.llm import decontaminate, preference, queries, simhash, token_stream

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def test_stages_one_after_another(spark, tmp_path):
    """Each stage against a plain version of it, on what its predecessor kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, str(DATA)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
        assert k == len(C.STAGES) - 1 or docs.columns == columns
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    good, single, clean, mixed, tokens = kept

    scores, _ = preference.score_documents(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    assert {r["doc_id"] for r in good} == {r["doc_id"] for r in scores.collect() if r["score"] >= preference.THRESHOLD}

    prints = [(r["doc_id"], simhash.fingerprint(r["text"].encode())) for r in good]
    group = {d: d for d, _ in prints}
    changed = True
    while changed:
        changed = False
        for a, x in prints:
            low = min(group[b] for b, y in prints if (x ^ y).bit_count() <= 3)
            if low < group[a]:
                group[a], changed = low, True
    assert {r["doc_id"] for r in single} == {d for d, g in group.items() if d == g}

    items = [decontaminate.words(r["text"].encode()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {tuple(ws[k : k + 10]) for ws in items for k in range(max(1, len(ws) - 9))}
    hit = lambda t: any(tuple(w[k : k + 10]) in windows for w in [decontaminate.words(t.encode())] for k in range(len(w)))
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in single if not hit(r["text"])}

    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in clean}
    assert words(mixed) == pytest.approx(1.5 * words(clean), rel=0.25)

    from tokenizers import Tokenizer

    tokenizer, at = Tokenizer.from_file(token_stream.default_tokenizer()), 0
    assert [r["doc_id"] for r in sorted(tokens, key=lambda r: r["start"])] == sorted(r["doc_id"] for r in mixed)
    for r in sorted(tokens, key=lambda r: r["start"]):
        ids = tokenizer.encode(source[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_registered(spark):
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op1_decontaminate", "op3_maxent", "op6_token_stream", "op9_preference"])
def test_runs(name, spark):
    rows = queries.queries()[name](spark, str(DATA))
    assert rows.count() == 200


def test_op1_as_sql(spark):
    from support import connection, same

    same(queries.queries()["op1_decontaminate"](spark, str(DATA)), queries.oracle_sql()["op1_decontaminate"], connection())
