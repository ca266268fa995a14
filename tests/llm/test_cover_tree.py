import numpy as np
import pytest

from support import DATA, connection, same

from plenum.llm import cover_tree as K


def brute(vectors, cosine):
    """(links, component) of every row by comparing all pairs."""
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in vectors]
    n, group = len(vectors), list(range(len(vectors)))
    links = [0] * n
    for i in range(n):
        for j in range(i):
            a, b = vectors[i][1], vectors[j][1]
            if good[i] and good[j] and len(a) == len(b) and np.dot(a, b) / np.sqrt(np.dot(a, a)) / np.sqrt(np.dot(b, b)) >= cosine:
                links[i] += 1
                links[j] += 1
                group = [group[j] if g == group[i] else g for g in group]
    ids = {}
    for k, g in enumerate(group):
        ids.setdefault(g, []).append(vectors[k][0])
    return [(vectors[k][0], links[k], min((x for x in ids[g] if x is not None), default=None)) for k, g in enumerate(group)]


@pytest.mark.parametrize("chunk, dim", [(4096, 6), (40, 6), (25, 3)])
def test_pairs(frame, chunk, dim):
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(60, dim))
    vectors = [(k, (base[rng.integers(60)] + rng.normal(scale=rng.choice([0.01, 0.3]), size=dim)).tolist()) for k in range(220)]
    vectors += [(300 + k, (base[0] + rng.normal(scale=0.01, size=dim)).tolist()) for k in range(60)] + [(400, vectors[3][1]), (401, vectors[3][1]), (401, vectors[3][1]), (None, vectors[3][1]), (402, [2 * x for x in vectors[5][1]])]
    vectors += [(500, None), (501, [0.0] * dim), (502, [float("nan")] * dim), (503, [None] * dim), (504, []), (505, [float("inf")] + [1.0] * (dim - 1)), (506, [1.0] * (dim + 2)), (507, [1.0] * (dim + 2)), (None, None)]
    found = K.linked(frame(vectors, "vec_id long, embedding array<double>", ("rid", "h", "m", "least")), chunk=chunk)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, brute(vectors, 0.9)))


def test_trees():
    rng = np.random.default_rng(1)
    for n, dim in ((1, 2), (50, 2), (400, 5)):
        x = K.unit(rng.normal(size=(n, dim)))
        tree = K.Tree(x)
        assert sorted(tree.order.tolist()) == list(range(n))
        for k in range(len(tree.centre)):
            members = tree.order[tree.low[k] : tree.high[k]]
            assert tree.centre[k] in members and (np.linalg.norm(x[members] - x[tree.centre[k]], axis=1) <= tree.radius[k] + 1e-9).all()
            own = range(tree.child[k], tree.child[k] + tree.children[k])
            if tree.children[k]:
                assert sorted(m for c in own for m in tree.order[tree.low[c] : tree.high[c]]) == sorted(members)


def test_empty(frame):
    assert K.linked(frame([], "vec_id long, embedding array<float>", ())).count() == 0
    assert [tuple(r) for r in K.linked(frame([(3, None)], "vec_id long, embedding array<float>", ())).collect()] == [(3, 0, 3)]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_as_sql(spark):
    same(K.op8_cover_tree(spark, str(DATA)), K.ORACLE["op8_cover_tree"], connection())
