import random

from plenum.llm.components import connected_components


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(500, k) for k in range(501, 600)] + [(rng.randrange(700, 800), rng.randrange(700, 800)) for _ in range(60)] + [(3, 3), (None, 4)]
    group = {}

    def top(x):
        group.setdefault(x, x)
        while group[x] != x:
            x = group[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((top(u), top(v)))
            group[b] = a
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {n: top(n) for n in group}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert {tuple(r) for r in connected_components(spark.createDataFrame([("b", "a"), ("c", "b")], "u string, v string")).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_hot_nodes(spark, monkeypatch):
    from plenum.llm import components as C

    monkeypatch.setattr(C, "MANY", 5)
    monkeypatch.setattr(C, "HOT_NODES", 20)
    edges = [(0, k) for k in range(1, 60)] + [(59, k) for k in range(100, 140)] + [(200 + k, 201 + k) for k in range(30)]
    found = {r["node"]: r["root"] for r in C.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{k: 0 for k in [*range(60), *range(100, 140)]}, **{200 + k: 200 for k in range(31)}}
