"""Centroid clustering: Lloyd's rounds on integer vectors by two trees.

Components x become integers floor(scale x).  Tasks gather vectors to blocks
of at most ``block`` different ones and build a *cover tree* over each: a node is a
vector that covers all below it within its radius, and its children are vectors
further than a fixed part of that radius from each other.  Blocks with their trees
are written once and read in every round.

A round builds a cover tree over the centroids, which all tasks get, and each
block descends both trees together.  A vector node A keeps those centroid nodes B
whose least possible distance, d(A, B) - rA - rB, isn't above the least d(A, B) + rA:
no centroid below the others can be nearest to anything below A.  If one
centroid is left, everything below A is its own, and the node's sums are
differences of prefix sums: none of its vectors is looked at.  Leaf pairs that stay
are compared exactly, in integers; ties go to the smaller number.  Tasks send one
row of sums for each centroid, so a round shuffles no vector.

The k centroids are the only thing that the driver holds or sends.  Sums, means
(floor of sum/count) and distances are exact: bounds only prune, with a margin
above the rounding of their square roots.

Kept are vectors with exactly ``dim`` components, none null or non-finite; others
have no row in the result.  The first centroids are the kept vectors with the
smallest sha256 of a salt and the id, equal ones by their components; a vector
without id is never one, but is assigned.  Rows with equal ids and repeated rows
are rows each.  With fewer than k kept vectors there are as many centroids, with
none an empty result.  Integers beyond 2 to the 26th are compared one by one with
Python's integers; a distance or sum that no long holds is null.  An empty
centroid stays.  Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Integers up to here have squared distances that 64 bits hold; beyond, Python's are used.
NARROW = 1 << 26
#: Margin of pruning, relative to the distances in a bound.
_MARGIN = 1e-9
#: Pairs whose differences are held at once.
_PAIRS = 1 << 15


class Tree(NamedTuple):
    """A cover tree: points in its order, and nodes from the top down.

    Node i covers points lo[i] to hi[i], the first of which is its own; its
    children are nodes child[i] to child[i] + children[i], none for a leaf.
    """

    points: np.ndarray
    order: np.ndarray  # place of each point among those given
    lo: np.ndarray
    hi: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray

    @classmethod
    def over(cls, points: np.ndarray, leaf: int = 8, base: float = 1.3) -> Tree:
        """Over different points.  Nodes shrink by ``base`` at least; those of at most ``leaf`` points aren't split."""
        x = points.astype(float)
        order = np.arange(len(x))
        lo, hi, radius, child, children = [0], [len(x)], [0.0], [0], [0]
        node = 0
        while node < len(lo):
            own = order[lo[node] : hi[node]]
            near = np.sqrt(((x[own] - x[own[:1]]) ** 2).sum(1))
            radius[node] = float(near.max(initial=0.0))
            if len(own) > leaf:
                owner, centres = np.zeros(len(own), np.int64), [0]
                # the furthest point becomes a child until all are near one: children lie apart and cover all
                while near[far := int(near.argmax())] > radius[node] / base:
                    d = np.sqrt(((x[own] - x[own[far]]) ** 2).sum(1))
                    owner[closer := d < near] = len(centres)
                    near = np.where(closer, d, near)
                    centres.append(far)
                child[node], children[node] = len(lo), len(centres)
                first = np.ones(len(own), bool)
                first[centres] = False
                order[lo[node] : hi[node]] = own[np.lexsort((first, owner))]
                edges = lo[node] + np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(centres)))])
                lo += edges[:-1].tolist()
                hi += edges[1:].tolist()
                for held, value in ((radius, 0.0), (child, 0), (children, 0)):
                    held += [value] * len(centres)
            node += 1
        return cls(points[order], order, *(np.array(v) for v in (lo, hi, radius, child, children)))


def _spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def _gaps(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of a[i] and b[j]."""
    found = np.empty(len(i), np.result_type(a, b))
    for at in range(0, len(i), _PAIRS):
        apart = a[i[at : at + _PAIRS]] - b[j[at : at + _PAIRS]]
        found[at : at + _PAIRS] = (apart * apart).sum(1)
    return found


class Nearest(NamedTuple):
    """Ranges of a tree's points and their nearest centroid; how many pairs of points and centroids were compared."""

    lo: np.ndarray
    hi: np.ndarray
    centroid: np.ndarray
    compared: int


def nearest(tree: Tree, centroids: Tree, number: np.ndarray) -> Nearest:
    """Descends both trees together; ``number`` is each centroid's, in the order of their tree, whose leaves are single."""
    x, c = tree.points.astype(float), centroids.points.astype(float)
    is_leaf, single = tree.children == 0, centroids.children == 0
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    compared = 0
    node, bound = np.zeros(1, np.int64), np.full(1, np.inf)
    at, other = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs: place in ``node``, and a centroid node
    while len(node):
        compared += len(at)
        d = np.sqrt(_gaps(x, tree.lo[node[at]], c, centroids.lo[other]))
        own, its = tree.radius[node[at]], centroids.radius[other]
        np.minimum.at(bound, at, d + own)
        keep = d - own - its <= bound[at] + _MARGIN * (1 + d + own + its)
        at, other, its = at[keep], other[keep], its[keep]
        left = np.bincount(at, minlength=len(node))
        open_pairs = np.bincount(at, ~single[other], minlength=len(node)) > 0
        one = (left == 1) & ~open_pairs
        exact = is_leaf[node] & ~open_pairs & ~one
        # a centroid node at least as wide as the vector node is opened first, and any at a leaf
        opens = ~single[other] & (is_leaf[node[at]] | (its >= tree.radius[node[at]]))
        waits = np.bincount(at, opens, minlength=len(node)) > 0
        deeper = ~one & ~exact & ~waits
        of_one = one[at]
        done.append((tree.lo[node[at[of_one]]], tree.hi[node[at[of_one]]], number[centroids.lo[other[of_one]]]))
        if exact.any():
            mine = exact[at]
            found, pairs = _compared(tree, node, at[mine], centroids, other[mine], number)
            done.append(found)
            compared += pairs
        # vectors' nodes that go on as they are, with wide centroid nodes opened
        stay = waits[at]
        stay_at, stay_other = at[stay & ~opens], other[stay & ~opens]
        wide_at, wide_other = at[opens & waits[at]], other[opens & waits[at]]
        n = centroids.children[wide_other]
        stay_at = np.concatenate([stay_at, np.repeat(wide_at, n)])
        stay_other = np.concatenate([stay_other, np.repeat(centroids.child[wide_other], n) + _spread(n)])
        # and those that are replaced by their children
        down = np.flatnonzero(deeper)
        n = tree.children[node[down]]
        first = np.zeros(len(node), np.int64)
        first[down] = np.cumsum(n) - n
        down_node, down_bound = np.repeat(tree.child[node[down]], n) + _spread(n), np.repeat(bound[down], n)
        pair = np.flatnonzero(deeper[at])
        m = tree.children[node[at[pair]]]
        down_at, down_other = np.repeat(first[at[pair]], m) + _spread(m), np.repeat(other[pair], m)
        kept = np.flatnonzero(waits)
        place = np.zeros(len(node), np.int64)
        place[kept] = np.arange(len(kept))
        node, bound = np.concatenate([node[kept], down_node]), np.concatenate([bound[kept], down_bound])
        at, other = np.concatenate([place[stay_at], len(kept) + down_at]), np.concatenate([stay_other, down_other])
    return Nearest(*(np.concatenate([f[i] for f in done]) for i in range(3)), compared)


def _compared(tree: Tree, node: np.ndarray, at: np.ndarray, centroids: Tree, other: np.ndarray, number: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """Leaves against single centroids, exactly."""
    size = tree.hi[node[at]] - tree.lo[node[at]]
    point = np.repeat(tree.lo[node[at]], size) + _spread(size)
    centroid = np.repeat(centroids.lo[other], size)
    d = _gaps(tree.points, point, centroids.points, centroid)
    order = np.lexsort((number[centroid], d, point))
    point = point[order]
    first = np.flatnonzero(np.concatenate([[True], point[1:] != point[:-1]]))
    return (point[first], point[first] + 1, number[centroid[order[first]]]), len(d)


def _exactly(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each point with Python's integers, all compared."""
    a, b = points.astype(object), centroids.astype(object)
    return np.array([min(range(len(b)), key=lambda j: (((p - b[j]) ** 2).sum(), j)) for p in a], np.int64)


class Centroids:
    """The k centroids of a round, with their tree if their integers are narrow."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.narrow = all(abs(v) <= NARROW for r in rows for v in r)
        self.array = np.array(rows, np.int64 if self.narrow else object).reshape(len(rows), -1)
        if self.narrow:
            distinct, first = np.unique(self.array, axis=0, return_index=True)  # equal centroids: the smallest number
            self.tree = Tree.over(distinct, leaf=1)
            self.number = first[self.tree.order]

    def of(self, tree: Tree | None, points: np.ndarray) -> Nearest:
        if tree is None or not self.narrow:
            at = np.arange(len(points))
            return Nearest(at, at + 1, _exactly(points, self.array), len(points) * len(self.rows))
        return nearest(tree, self.tree, self.number)


def integers(x: np.ndarray, scale: int) -> tuple[np.ndarray, bool]:
    """floor(scale x) of finite components, and whether they are narrow; wide ones are Python's integers."""
    with np.errstate(over="ignore"):
        found = np.floor(scale * x)
    if np.abs(found).max(initial=0) <= NARROW:
        return found.astype(np.int64), True
    whole = lambda v: int(v) * scale if abs(v) >= 2.0**52 else math.floor(scale * v)
    return np.array([[whole(v) for v in row] for row in x.tolist()], object).reshape(x.shape), False


class Block(NamedTuple):
    """Vectors of a block: ids, and for each row the place of its vector in the tree's order."""

    ids: list
    row: np.ndarray
    points: np.ndarray
    tree: Tree | None
    before: np.ndarray  # sums of the rows' vectors up to each place, the last column counts rows

    @classmethod
    def of(cls, ids: list, rows: np.ndarray, points: np.ndarray, narrow: bool) -> Block:
        tree = Tree.over(points) if narrow else None
        if tree is not None:
            place = np.empty(len(points), np.int64)
            place[tree.order] = np.arange(len(points))
            rows, points = place[rows], tree.points
        times = np.bincount(rows, minlength=len(points)).astype(points.dtype)
        weighted = np.concatenate([points * times[:, None], times[:, None]], 1)
        return cls(ids, rows, points, tree, np.concatenate([np.zeros((1, weighted.shape[1]), points.dtype), np.cumsum(weighted, 0)]))

    def packed(self) -> bytes:
        """Integers in as few bytes as they need; sums are made again."""
        if self.tree is None:
            return pickle.dumps((self.ids, self.row, self.points, None), 5)
        small = np.int16 if np.abs(self.points).max(initial=0) < 1 << 15 else np.int32
        nodes = [v.astype(np.int32) for v in (self.tree.lo, self.tree.hi, self.tree.child, self.tree.children)]
        return pickle.dumps((self.ids, self.row.astype(np.int32), self.points.astype(small), (*nodes, self.tree.radius)), 5)

    @classmethod
    def unpacked(cls, body: bytes) -> Block:
        ids, row, points, nodes = pickle.loads(body)
        if nodes is None:
            return cls.of(ids, row, points, False)
        points = points.astype(np.int64)
        lo, hi, child, children = (v.astype(np.int64) for v in nodes[:4])
        tree = Tree(points, np.arange(len(points)), lo, hi, nodes[4], child, children)
        times = np.bincount(row, minlength=len(points))
        weighted = np.concatenate([points * times[:, None], times[:, None]], 1)
        return cls(ids, row, points, tree, np.concatenate([np.zeros((1, weighted.shape[1]), np.int64), np.cumsum(weighted, 0)]))


class Lloyd:
    """``k`` centroids after so many ``rounds`` over vectors of ``dim`` components, as integers floor(scale x)."""

    def __init__(self, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2:", block: int = 1024, block_rows: int = 16_384):
        self.k, self.rounds, self.dim, self.scale, self.salt, self.block, self.block_rows = k, rounds, dim, scale, salt, block, block_rows

    def kept(self, table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
        """(vec_id, x) of usable vectors, as doubles."""
        finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("x"))
        return rows.where(F.col("x").isNotNull() & (F.size("x") == self.dim) & finite)

    def start(self, kept: DataFrame) -> list[list[int]]:
        """The first centroids."""
        mark = F.sha2(F.concat(F.lit(self.salt), F.col("vec_id").cast("string")).cast("binary"), 256)
        chosen = kept.where("vec_id is not null").orderBy(mark, "x").limit(self.k).select("x").collect()
        return [integers(np.array([r["x"]], float), self.scale)[0][0].tolist() for r in chosen]

    def blocks(self, kept: DataFrame) -> DataFrame:
        """(body): blocks of vectors with their trees."""
        dim, scale, block, most_rows = self.dim, self.scale, self.block, self.block_rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[bool, tuple[list, list, dict]] = {True: ([], [], {}), False: ([], [], {})}

            def out(narrow: bool) -> pa.RecordBatch:
                ids, rows, places = held[narrow]
                held[narrow] = [], [], {}
                kind = np.int64 if narrow else object
                body = Block.of(ids, np.array(rows), np.array(list(places), kind).reshape(len(places), dim), narrow).packed()
                return pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], ["body"])

            for batch in common.sliced(batches, 256):
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
                wide = np.abs(x).max(1) > NARROW / scale - 1
                for narrow in (True, False):
                    own = np.flatnonzero(wide != narrow)
                    found = integers(x[own], scale)[0].tolist() if own.size else []
                    for vec_id, row in zip(batch.column(0).take(pa.array(own)).to_pylist(), found):
                        ids, rows, places = held[narrow]
                        ids.append(vec_id)
                        rows.append(places.setdefault(tuple(row), len(places)))
                    if len(held[narrow][0]) >= most_rows or len(held[narrow][2]) >= block:
                        yield out(narrow)
            for narrow in (True, False):
                if held[narrow][0]:
                    yield out(narrow)

        return kept.select("vec_id", "x").mapInArrow(run, "body binary")

    def moved(self, blocks: DataFrame, rows: list[list[int]]) -> list[list[int]]:
        """The centroids after a round."""
        now, dim = Centroids(rows), self.dim

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list[int]] = {}
            for batch in batches:
                for body in batch.column(0):
                    block = Block.unpacked(body.as_py())
                    found = now.of(block.tree, block.points)
                    order = np.argsort(found.centroid, kind="stable")
                    centroid = found.centroid[order]
                    first = np.flatnonzero(np.concatenate([[True], centroid[1:] != centroid[:-1]]))
                    parts = np.add.reduceat((block.before[found.hi] - block.before[found.lo])[order], first)
                    for c, part in zip(centroid[first].tolist(), parts.tolist()):
                        total[c] = [a + b for a, b in zip(total[c], part)] if c in total else part
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pickle.dumps(v, 5) for v in total.values()], pa.binary())], ["cluster", "sums"])

        def merged(group: pa.Table) -> pa.Table:
            total = [0] * (dim + 1)
            for part in group.column("sums"):
                total = [a + b for a, b in zip(total, pickle.loads(part.as_py()))]
            return pa.table([group.column("cluster").slice(0, 1), pa.array([pickle.dumps([v // total[dim] for v in total[:dim]], 5)], pa.binary())], ["cluster", "mean"])

        parts = blocks.mapInArrow(sums, "cluster int, sums binary")
        found = {r["cluster"]: pickle.loads(r["mean"]) for r in parts.groupBy("cluster").applyInArrow(merged, "cluster int, mean binary").collect()}  # k rows
        return [found.get(i, row) for i, row in enumerate(rows)]

    def assigned(self, blocks: DataFrame, rows: list[list[int]]) -> DataFrame:
        """(vec_id, cluster, distance) of every kept vector."""
        now = Centroids(rows)
        long = lambda v: v if v < 1 << 63 else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for body in batch.column(0):
                    block = Block.unpacked(body.as_py())
                    found = now.of(block.tree, block.points)
                    cluster = np.empty(len(block.points), np.int64)
                    cluster[np.repeat(found.lo, found.hi - found.lo) + _spread(found.hi - found.lo)] = np.repeat(found.centroid, found.hi - found.lo)
                    distance = _gaps(block.points, np.arange(len(cluster)), now.array, cluster)
                    kind = pa.array(distance) if distance.dtype != object else pa.array(list(map(long, distance.tolist())), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), pa.array(cluster[block.row].astype(np.int32)), kind.take(pa.array(block.row))], ["vec_id", "cluster", "distance"])

        return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")

    def fit(self, blocks: DataFrame, rows: list[list[int]]) -> list[list[int]]:
        for _ in range(self.rounds if rows else 0):
            rows = self.moved(blocks, rows)
        return rows

    def cluster(self, table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
        """(vec_id, cluster, distance) of every kept vector, as a written table, and the centroids."""
        spark = table.sparkSession
        store = common.Scratch(spark, "dualtree")
        kept = self.kept(table, id_column, vector_column)
        first = self.start(kept)
        if not first:
            return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
        blocks = store.write(self.blocks(kept), "blocks")
        rows = self.fit(blocks, first)
        return store.write(self.assigned(blocks, rows), "assigned"), rows


def centroid_clusters(table: DataFrame, k: int = 40, rounds: int = 5) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) with production parameters."""
    spark = table.sparkSession
    found, rows = Lloyd(k, rounds).cluster(table)
    marks = [(i, hashlib.sha256(",".join(map(str, r)).encode()).hexdigest()) for i, r in enumerate(rows)]
    marks = spark.createDataFrame(marks, "cluster int, centroid_sha256 string")  # k rows
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    # a sum over distances of which one is null is null, and so is one beyond a long
    whole = lambda n: F.when(F.col("missing") == 0, n.try_cast("long"))
    by_cluster = found.groupBy("cluster").agg(exact.alias("s"), F.count_if(F.col("distance").isNull()).alias("missing")).withColumn("cluster_inertia", whole(F.col("s")))
    total = by_cluster.agg(F.sum("s").alias("s"), F.sum("missing").alias("missing")).select(whole(F.col("s")).alias("inertia"))
    of_cluster = marks.join(by_cluster.drop("s", "missing"), "cluster").crossJoin(total)  # k rows
    return found.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
