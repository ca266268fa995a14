"""Connected components of a graph that no single machine holds: alternating star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import written


#: Neighbours from which a node is hot, at least; and hot nodes at most, for which that number rises with the graph.
MANY, HOT_NODES = 100_000, 50_000


def beside(rows: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """rows(u, v), n at most, with m and its other columns of low(u, ...), one row for each u, by u.

    A node with very many rows is not gathered: its row of low is broadcast, and there are n / limit such nodes
    at most. The others meet by shuffle. Where no node can have that many rows there is only the latter.
    """
    limit = max(MANY, n // HOT_NODES)
    if n <= limit:
        return rows.join(low, "u")
    hot = F.broadcast(rows.groupBy("u").count().where(F.col("count") > limit).select("u").join(low, "u"))
    cold = rows.join(F.broadcast(hot.select("u")), "u", "left_anti")
    return cold.join(low, "u").unionByName(rows.join(hot, "u"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit((1 << 31) - 1))).alias("s")).first()
    return row["n"], row["x"], row["s"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u, v), any comparable type -> (node, root): root is the smallest node that is reachable.

    Only nodes with an edge to another node are returned. Each round is a large-star step (every
    neighbour above u is tied to the smallest of u's neighbourhood) and a small-star step (likewise
    below); after the last one the edges are stars. A node with very many neighbours costs a partial
    minimum and is told to its edges by broadcast, never a list. Each round is a table in the shared folder.
    Null ends and loops are ignored; no edges give an empty result.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    if not state[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = beside(both, low, 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = beside(large, low, 2 * state[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
