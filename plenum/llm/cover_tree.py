"""Exact threshold pairs of embeddings by dual traversal of cover trees.

Vectors are scaled to length 1 in double precision; a cosine of at least c is then a distance of at most
t = sqrt(2 - 2c). Equal vectors are one point with a multiplicity. The points are dealt to cells around
centres of a bounded sample, large cells to several chunks by hash, and each chunk of about CHUNK points
gets a cover tree: nested levels whose radii halve, every node with its centre, its true covering radius
and its children. Two chunks whose centres are further apart than their radii and t are never compared;
of the others the trees are descended together. A pair of nodes is dropped if no two of their points can
be near, counted whole if all must be, and opened otherwise; at the leaves cosines are computed.

A pair of chunks is one task. It returns how many points each point is linked with, and a spanning forest
of the links, not the links.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import written
from plenum.llm.components import connected_components

#: Points of a chunk, about; points that centres are chosen from, cells at most, centres sent at a time.
CHUNK, SAMPLE, CELLS, SUMMARY = 4096, 2048, 256, 20_000
#: Points of a leaf at most, of a node not worth keeping, radius below which nodes are leaves; slack of distances;
#: pairs of points held at a time.
LEAF, TINY, FLAT, SLACK, PAIRS = 24, 8, 0.1, 1e-7, 1 << 16


def unit(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distance(products: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * products, 0))


class Tree:
    """A cover tree over the rows of x, which are of length 1, as flat arrays by node.

    Node k has the centre row centre[k], the covering radius radius[k], the member rows
    order[low[k]:high[k]] and the children child[k] to child[k] + children[k]. Nodes 0 to top are the first
    level, of radius 1; each further one has half the radius of the one above.
    """

    FIELDS = ("order", "centre", "radius", "low", "high", "child", "children")

    def __init__(self, x: np.ndarray):
        self.x, self.single = x, x.astype(np.float32)
        self.order = np.arange(len(x))
        nodes: list[list] = []
        self.top = self._split(nodes, 0, len(x), 0, 2.0) if len(x) else 0
        table = np.array(nodes, float).reshape(-1, 6)
        self.centre, self.low, self.high, self.child, self.children = (table[:, k].astype(np.int64) for k in (0, 2, 3, 4, 5))
        self.radius = table[:, 1]

    @classmethod
    def of(cls, x: np.ndarray, arrays: dict, top: int) -> Tree:
        tree = cls.__new__(cls)
        tree.x, tree.single, tree.top = x, x.astype(np.float32), top
        tree.__dict__.update({k: v if k == "radius" else v.astype(np.int64) for k, v in arrays.items()})
        return tree

    def arrays(self) -> dict:
        """The tree without its points, for sending; rows of a chunk and nodes are numbered in 32 bits."""
        return {k: getattr(self, k) if k == "radius" else getattr(self, k).astype(np.int32) for k in self.FIELDS}

    def _split(self, nodes: list, low: int, high: int, centre: int, radius: float) -> int:
        """Append the next level below the members order[low:high], the node of the same centre first; its nodes in number.

        A point near no other is a node at once; the others are taken in order, each with what is near it.
        A wide node of at most TINY points is replaced by its points, the leaves that it would end in.
        """
        members, half = self.order[low:high].copy(), radius / 2
        near = np.zeros((len(members), len(members)), bool)
        for at in range(0, len(members), 1024):
            near[at : at + 1024] = self.single[members[at : at + 1024]] @ self.single[members].T >= 1 - half * half / 2
        np.fill_diagonal(near, True)
        alone = near.sum(axis=1) == 1
        groups, open_ = [], ~alone
        for k in [int(np.flatnonzero(members == centre)[0]), *np.flatnonzero(open_).tolist()]:
            if open_[k]:
                inside = np.flatnonzero(near[k] & open_)
                open_[inside] = False
                groups.append(members[np.concatenate([[k], inside[inside != k]])])
        groups += [members[k : k + 1] for k in np.flatnonzero(alone)]
        far = [float(distance(self.x[g] @ self.x[g[0]]).max()) if len(g) > 1 else 0.0 for g in groups]
        groups = [part for g, f in zip(groups, far) for part in ([g] if len(g) > TINY or f <= FLAT else np.split(g, len(g)))]
        first = len(nodes)
        self.order[low:high] = np.concatenate(groups)
        for own in groups:
            far = float(distance(self.x[own] @ self.x[own[0]]).max()) + SLACK if len(own) > 1 else 0.0
            nodes.append([own[0], far, low, low + len(own), 0, 0])
            low += len(own)
        for k in range(first, len(nodes)):
            centre, far, a, b = nodes[k][:4]
            if b - a > LEAF and far > FLAT:
                level = half
                while far <= level / 2:
                    level /= 2
                nodes[k][4] = len(nodes)
                nodes[k][5] = self._split(nodes, a, b, centre, level)
        return len(groups)


def _union(label: np.ndarray, members: np.ndarray) -> None:
    own = label[members]
    if (own != own[0]).any():
        found = np.unique(own)
        label[np.isin(label, found[1:])] = found[0]


def dual(a: Tree, b: Tree | None, cosine: float, wa: np.ndarray, wb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links within a (b is None) or between a and b: weights linked with each point of a and of b, and labels of a's then b's points.

    Centres are compared in single precision with slack, so a pair is dropped only if it holds no link;
    links are counted in double precision, or by the triangle inequality.
    """
    same, b = b is None, a if b is None else b
    limit = np.sqrt(2 - 2 * cosine)
    na, nb, off = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64), 0 if same else len(a.x)
    label = np.arange(len(a.x) if same else len(a.x) + len(b.x))
    other = na if same else nb

    def pairs(left: np.ndarray, right: np.ndarray, square: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the given nodes, of a and of b, that may hold links; of a square, one order of each.

        Pairs of single points are settled on the way, PAIRS at a time, and not returned.
        """
        found = [(left[:0], right[:0])]
        order_l, order_r = (x[np.argsort(t.radius[x], kind="stable")] for x, t in ((left, a), (right, b)))
        for at in range(0, len(order_l), 1024):
            part = order_l[at : at + 1024]
            reach = np.minimum(a.radius[part].max() + b.radius[order_r] + limit + 1e-4, 2.0)
            near = a.single[a.centre[part]] @ b.single[b.centre[order_r]].T >= (1 - reach * reach / 2 - 1e-5).astype(np.float32)
            rows, columns = np.nonzero(near)
            for k in range(0, len(rows), PAIRS):
                i, j = part[rows[k : k + PAIRS]], order_r[columns[k : k + PAIRS]]
                if square:
                    i, j = i[i <= j], j[i <= j]
                dot = np.einsum("ij,ij->i", a.x[a.centre[i]], b.x[b.centre[j]])
                good = distance(dot) <= a.radius[i] + b.radius[j] + limit + SLACK
                single = (a.high[i] - a.low[i] == 1) & (b.high[j] - b.low[j] == 1)
                linked = single & (dot >= cosine) & ~(same & (i == j))
                points(a.centre[i[linked]], b.centre[j[linked]])
                found.append((i[good & ~single], j[good & ~single]))
        i, j = (np.concatenate(x) for x in zip(*found))
        return i, j

    def points(i: np.ndarray, j: np.ndarray) -> None:
        """Links between pairs of rows."""
        np.add.at(na, i, wb[j])
        np.add.at(other, j, wa[i])
        new = label[i] != label[j + off]
        for p, q in zip(i[new].tolist(), (j[new] + off).tolist()):
            if label[p] != label[q]:
                _union(label, np.array([p, q]))

    def blocks(ma: np.ndarray, mb: np.ndarray, alike: bool) -> None:
        """Links between two sets of rows, or within one."""
        for at in range(0, len(ma), 1024):
            part = ma[at : at + 1024]
            near = a.x[part] @ b.x[mb].T >= cosine
            if alike:
                near[np.arange(len(part)), np.arange(at, at + len(part))] = False
            if near.any():
                na[part] += near @ wb[mb]
                if not alike:
                    other[mb] += wa[part] @ near
                for k in np.flatnonzero(near.any(axis=1)):
                    _union(label, np.append(mb[near[k]] + off, part[k]))

    def whole(ma: np.ndarray, mb: np.ndarray, alike: bool) -> None:
        """Every row of one set with every one of the other, or of the same."""
        if alike:
            na[ma] += wa[ma].sum() - wa[ma]
        else:
            na[ma] += wb[mb].sum()
            other[mb] += wa[ma].sum()
        _union(label, np.concatenate([ma, mb + off]))

    stack = [pairs(np.arange(a.top), np.arange(b.top), same)]
    while stack:
        i, j = stack.pop()
        for p, q in zip(i.tolist(), j.tolist()):
            ma, mb, alike = a.order[a.low[p] : a.high[p]], b.order[b.low[q] : b.high[q]], same and p == q
            reach = 2 * a.radius[p] if alike else a.radius[p] + b.radius[q] + float(distance(a.x[a.centre[p]] @ b.x[b.centre[q]]))
            ka, kb = np.arange(a.child[p], a.child[p] + a.children[p]), np.arange(b.child[q], b.child[q] + b.children[q])
            if reach + SLACK <= limit:
                whole(ma, mb, alike)
            elif not len(ka) and not len(kb):
                blocks(ma, mb, alike)
            elif alike:
                stack.append(pairs(ka, ka, True))
            elif len(ka) and (not len(kb) or a.radius[p] >= b.radius[q]):
                stack.append(pairs(ka, np.array([q]), False))
            else:
                stack.append(pairs(np.array([p]), kb, False))
    return na, nb, label


def points(vectors: DataFrame) -> DataFrame:
    """(rid, h, embedding, least, m, dim): each different usable vector, its smallest vec_id and its multiplicity."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.where(F.coalesce(good, F.lit(False))).groupBy(F.xxhash64("embedding").alias("h"), "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    return written(rows.select(F.monotonically_increasing_id().alias("rid"), "h", "embedding", "least", "m", F.size("embedding").alias("dim")), "points")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def chunks(rows: DataFrame, dim: int, n: int, chunk: int = CHUNK) -> DataFrame:
    """Points of one dimension -> (chunk, tree, centre, radius), each row a chunk with its cover tree."""
    cells = min(CELLS, -(-n // chunk))
    low = F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) <= int(min(1.0, SAMPLE / n) * (1 << 30))
    drawn = sorted(rows.where(low).select("rid", "embedding").collect())[:SAMPLE] or rows.select("rid", "embedding").limit(1).collect()
    some = unit(np.array([r["embedding"] for r in drawn], float).reshape(-1, dim))
    picked, far = [0], distance(some @ some[0])
    while len(picked) < min(cells, len(some)):
        picked.append(int(far.argmax()))
        far = np.minimum(far, distance(some @ some[picked[-1]]))
    centres = rows.sparkSession.sparkContext.broadcast(some[picked])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (unit(_matrix(batch.column("embedding"))) @ centres.value.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("embedding"), batch.column("m"), pa.array(near)], ["rid", "embedding", "m", "cell"])

    kind = rows.schema["embedding"].dataType.simpleString()
    dealt = written(rows.select("rid", "embedding", "m").mapInArrow(deal, f"rid long, embedding {kind}, m long, cell long"), "cells")
    parts = dealt.groupBy("cell").agg(F.ceil(F.count("*") / chunk).alias("parts"))
    dealt = dealt.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("rid"), "parts"))  # at most CELLS rows

    def build(group: pd.DataFrame) -> pd.DataFrame:
        raw = np.array(group["embedding"].tolist())
        x = unit(raw)
        tree = Tree(x)
        middle = centres.value[group["cell"].iloc[0]]
        radius = float(distance(x @ middle).max()) + SLACK
        blob = pickle.dumps((raw, tree.arrays(), tree.top, group["rid"].to_numpy(), group["m"].to_numpy()), 5)
        return pd.DataFrame({"tree": [blob], "centre": [middle.tobytes()], "radius": [radius]})

    made = written(dealt.groupBy("cell", "part").applyInPandas(build, "tree binary, centre binary, radius double"), "trees")
    return written(made.select(F.monotonically_increasing_id().alias("chunk"), "tree", "centre", "radius"), "chunks")


def candidates(made: DataFrame, cosine: float) -> DataFrame:
    """(a, b): pairs of chunks, a <= b, that may hold links. The centres go out in blocks of SUMMARY chunks."""
    sc, limit, out = made.sparkSession.sparkContext, float(np.sqrt(2 - 2 * cosine)), None
    slim = made.select("chunk", "centre", "radius")

    def against(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, centres, radii = shared.value
            for batch in batches:
                own = np.array([np.frombuffer(c, np.float64) for c in batch.column("centre").to_pylist()]).reshape(batch.num_rows, -1)
                d = distance(own @ centres.T)
                mine = batch.column("chunk").to_numpy()
                i, j = np.nonzero((d <= batch.column("radius").to_numpy()[:, None] + radii + limit + SLACK) & (mine[:, None] <= ids))
                yield pa.RecordBatch.from_arrays([pa.array(mine[i]), pa.array(ids[j])], ["a", "b"])

        return run

    def block(rows):
        return np.array([r["chunk"] for r in rows]), np.array([np.frombuffer(r["centre"], np.float64) for r in rows]), np.array([r["radius"] for r in rows])

    held = []
    for row in slim.toLocalIterator():
        held.append(row)
        if len(held) == SUMMARY:
            found = slim.mapInArrow(against(sc.broadcast(block(held))), "a long, b long")
            out, held = found if out is None else out.union(found), []
    if held:
        found = slim.mapInArrow(against(sc.broadcast(block(held))), "a long, b long")
        out = found if out is None else out.union(found)
    return out


def compared(made: DataFrame, cosine: float) -> DataFrame:
    """(rid, n, other): weight linked with a point in one pair of chunks, and its neighbour in the spanning forest or null."""
    pairs = written(candidates(made, cosine), "pairs")
    # each chunk goes to every pair that it is in: once, and only there do two trees meet
    ends = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("chunk")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("chunk")), F.struct(F.lit(1).alias("side"), F.col("b").alias("chunk"))))
    both = pairs.select("a", "b", F.explode(ends).alias("e")).select("a", "b", "e.side", "e.chunk").join(made.select("chunk", "tree"), "chunk").select("a", "b", "side", "tree")

    def load(blob: bytes):
        raw, arrays, top, rid, m = pickle.loads(blob)
        return Tree.of(unit(raw), arrays, top), rid, m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            for pa_, pb_, side, tree in zip(*(batch.column(c) for c in ("a", "b", "side", "tree"))):
                if pa_.as_py() != pb_.as_py() and side.as_py() == 0:
                    first = tree.as_py()
                    continue
                a, rid, wa = load(tree.as_py() if side.as_py() == 0 else first)
                b, more, wb = load(tree.as_py()) if side.as_py() else (None, rid[:0], wa)
                na, nb, label = dual(a, b, cosine, wa, wb)
                ids, n = np.concatenate([rid, more]), na if b is None else np.concatenate([na, nb])
                root = np.where(label != np.arange(len(label)), ids[label], -1)
                seen = np.flatnonzero((n > 0) | (root >= 0))
                yield pa.RecordBatch.from_arrays([pa.array(ids[seen]), pa.array(n[seen]), pa.array(root[seen], mask=root[seen] < 0)], ["rid", "n", "other"])

    return both.repartition("a", "b").sortWithinPartitions("a", "b", "side").mapInArrow(run, "rid long, n long, other long")


def linked(vectors: DataFrame, cosine: float = 0.9, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of vectors(vec_id, embedding).

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors
    of different length neither. A row counts every other row that it is linked with, so repeated rows count
    each other. component_id is the smallest vec_id reachable by links; a row without a vec_id takes part
    and is its own (null) component only if no row with one is reachable. 0 < cosine <= 1.
    """
    rows, found = points(vectors), None
    for r in rows.groupBy("dim").count().orderBy("dim").collect():
        part = compared(chunks(rows.where(F.col("dim") == r["dim"]), r["dim"], r["count"], chunk), cosine)
        found = part if found is None else found.union(part)
    if found is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = written(found, "links")
    roots = connected_components(found.where("other is not null").select(F.col("rid").alias("u"), F.col("other").alias("v")))
    tied = written(rows.select("rid", "least").join(roots.withColumnRenamed("node", "rid"), "rid"), "tied", compact=True)
    # a table of its own, so that a component of very many vectors can be split in the join
    names = tied.select("rid", "root").join(written(tied.groupBy("root").agg(F.min("least").alias("name")), "roots", compact=True), "root").select("rid", "name")
    counts = found.groupBy("rid").agg(F.sum("n").alias("n"))
    named = rows.join(counts, "rid", "left").join(names, "rid", "left")
    named = written(named.select("h", "embedding", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("name", "least").alias("component_id")), "named")
    both = vectors.withColumn("h", F.xxhash64("embedding")).join(named, ["h", "embedding"], "left")
    usable = F.col("n_links").isNotNull()
    return both.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(usable, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))


def op8_cover_tree(spark, sf_dir: str) -> DataFrame:
    """Every vector with its links at a cosine of 0.9, its component, and whether it is the component's first."""
    rows = linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return rows.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


ORACLE = {
    "op8_cover_tree": """
with recursive usable as (
    select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
    where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as u, b.vec_id as v from usable a join usable b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
reach(u, v) as (select vec_id, vec_id from embeddings union select r.u, l.v from reach r join links l on l.u = r.v),
least as (select u, min(v) as component_id from reach group by u),
n as (select u, count(*) as n_links from links group by u)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings e join least on least.u = vec_id left join n on n.u = vec_id"""
}
