"""Embedding near-duplicates by a forest of random-projection trees.

Each tree splits vectors again and again at the median of their projection on a
random direction.  Vectors close to a split go to both sides, so that near
neighbours are seldom parted; and trees differ, so that few pairs are parted in
all of them.  Vectors are compared within leaves only, by cosine in double
precision, and links become components.

The splits are fitted on a bounded sample (``sample`` classes or a 32nd of them, but
no more than ``MOST_SAMPLED``, chosen by a hash); every vector is indexed.  Only vectors with equal labels and
equal length are compared: each such *space* has trees of its own.

Equal vectors with equal labels form one class with a multiplicity, so copies
cost nothing.  A pair that meets in several leaves is counted where its leaf
number is smallest, which both vectors know, so leaves return a count for each
vector and a spanning forest of their links, and never pairs.  A leaf with more
than ``block`` classes is compared block by block in different tasks.

A split inside a tight cluster would part many links at once, in every tree.  So
links among some vectors of a node are looked at.  The cut that parts the fewest is
taken; where ``dense`` of the pairs are links, or a twentieth of that and each cut
parts more than 2 % of them, the node stays whole, as one large leaf whose work is
in proportion to its links.

Vectors that are null, zero, or hold null or non-finite components, and those
with a null label, link with nothing: a component of their own.  Rows with
a null id are counted as copies and linked; their component is their class's, the
smallest id in it, and null if it has none.  Repeated
rows are copies.  An empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import stars
from . import common


#: Vectors of a node whose links are looked at, and the cuts that are tried, the median first.
PROBE, QUANTILES = 512, (0.5, 0.4, 0.6, 0.3, 0.7)

#: Vectors that splits are fitted on, at most: what the driver holds.
MOST_SAMPLED = 200_000

#: The share of links that a cut may part where they are many.
PARTED = 0.02


def _comparable(table: DataFrame, column: str):
    """A label as text, such that equal labels are equal texts; zero has one sign."""
    value = F.col(column)
    return (value + F.lit(0).cast(dict(table.dtypes)[column]) if dict(table.dtypes)[column] in ("float", "double") else value).cast("string")


class Tree:
    """Nodes in arrays: a direction and a threshold each, children, or a leaf number."""

    def __init__(self) -> None:
        self.directions: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.sides: list[tuple[int, int]] = []

    def grow(self, x: np.ndarray, most: float, spill: float, rng: np.random.Generator, first_leaf: int, threshold: float = 1.0, dense: float = 1.0) -> int:
        """Fits splits to unit vectors until at most ``most`` are in a leaf, or its links forbid a split; returns the next leaf number."""
        self.next, self.threshold, self.dense = first_leaf, threshold, dense
        self.root = self._node(x, most, spill, rng)
        return self.next

    def _split(self, x: np.ndarray, spill: float, rng: np.random.Generator) -> tuple[np.ndarray, float] | None:
        """A direction and a cut that part the fewest links among some of the vectors; nothing for a tight cluster."""
        some = x if len(x) <= PROBE else x[rng.choice(len(x), PROBE, replace=False)]
        a, b = np.nonzero(np.triu(some @ some.T >= self.threshold, 1))
        density = len(a) / (len(some) * (len(some) - 1) / 2)
        if density >= self.dense:
            return None
        best, least = None, np.inf
        for _ in range(6):
            direction = rng.normal(size=x.shape[1])
            direction /= np.linalg.norm(direction)
            p, q = x @ direction, some @ direction
            low, high = np.minimum(q[a], q[b]), np.maximum(q[a], q[b])
            for cut in np.quantile(p, QUANTILES).tolist():
                if max((p <= cut + spill).sum(), (p > cut - spill).sum()) < 0.8 * len(x):
                    parted = ((low <= cut - spill) & (high > cut + spill)).sum()
                    if parted < least:
                        best, least = (direction, cut), parted
                if least == 0:
                    return best
        return None if density >= self.dense / 20 and least > PARTED * len(a) else best

    def _node(self, x: np.ndarray, most: float, spill: float, rng: np.random.Generator) -> int:
        if len(x) > max(most, 8) and (found := self._split(x, spill, rng)):
            direction, cut = found
            p = x @ direction
            node = len(self.cuts)
            self.directions.append(direction)
            self.cuts.append(cut)
            self.sides.append((0, 0))
            self.sides[node] = (self._node(x[p <= cut + spill], most, spill, rng), self._node(x[p > cut - spill], most, spill, rng))
            return node
        self.next += 1
        return -self.next  # leaf numbers are negative places, less one

    def leaves(self, x: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of unit vectors, a row for each leaf that a vector goes to."""
        rows, found = [], []
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if not own.size:
                continue
            if node < 0:
                rows.append(own)
                found.append(np.full(len(own), -node - 1))
                continue
            p = x[own] @ self.directions[node] - self.cuts[node]
            todo += [(self.sides[node][0], own[p <= spill]), (self.sides[node][1], own[p > -spill])]
        return np.concatenate(rows), np.concatenate(found)


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Forest:
    def __init__(self, threshold: float = 0.93, trees: int = 5, leaf: int = 256, spill: float = 0.35, sample: int = 20_000, block: int = 2048, seed: int = 11, dense: float = 0.2):
        self.threshold, self.trees, self.leaf, self.spill, self.sample, self.block, self.seed, self.dense = threshold, trees, leaf, spill, sample, block, seed, dense

    def width(self, dim: int) -> float:
        """Half the band around a split: ``spill`` standard deviations of the projected distance of a pair at the threshold."""
        return self.spill * float(np.sqrt((2 - 2 * self.threshold) / dim))

    def fit(self, classes: DataFrame) -> dict[tuple[int, int], list[Tree]]:
        """Trees of each space (label, length), from about ``sample`` classes, and never more than twice as many."""
        counts = {(r["label"], r["dim"]): r["count"] for r in classes.groupBy("label", "dim").count().collect()}
        # leaves keep their size up to 32 * MOST_SAMPLED classes, and grow beyond
        wanted = min(max(self.sample, sum(counts.values()) // 32), MOST_SAMPLED)
        share = min(1.0, wanted / max(1, sum(counts.values())))
        drawn = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_003)) < share * 1_000_003).select("label", "dim", "rep", "vector").limit(2 * wanted)
        sampled: dict[tuple[int, int], list] = {}
        for r in sorted(drawn.collect(), key=lambda r: (r["label"], r["dim"], r["rep"])):
            sampled.setdefault((r["label"], r["dim"]), []).append(r["vector"])
        rng, leaf, found = np.random.default_rng(self.seed), 0, {}
        for space in sorted(counts):
            x = unit(np.array(sampled[space], float)) if space in sampled else np.empty((0, space[1]))
            found[space] = []
            for _ in range(self.trees):
                tree = Tree()
                leaf = tree.grow(x, self.leaf * len(x) / counts[space], self.width(space[1]), rng, leaf, self.threshold, self.dense)
                found[space].append(tree)
        return found

    def _route(self, classes: DataFrame, forest, kind: str) -> DataFrame:
        """(leaf, rep, copies, raw, leaves): a row for each leaf of each class; ``leaves`` are all its leaves, ``kind`` the numbers of ``raw``."""
        spark = classes.sparkSession
        trees, width = spark.sparkContext.broadcast(forest), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.sliced(batches, 2000):
                label, dim, rep, copies = np.array(batch.column(0).to_pylist(), object), *(batch.column(i).to_numpy() for i in (1, 2, 3))
                for space in sorted(set(zip(label.tolist(), dim.tolist()))):
                    own = np.flatnonzero((label == space[0]) & (dim == space[1]))
                    x = np.ascontiguousarray(batch.column(4).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1), "<f8")
                    unit_x = unit(x)
                    routed = [t.leaves(unit_x, width(space[1])) for t in trees.value[space]]
                    row, leaf = (np.concatenate([r[i] for r in routed]) for i in (0, 1))
                    order = np.lexsort((leaf, row))
                    row, leaf = row[order], leaf[order]
                    edges = np.searchsorted(row, np.arange(len(own) + 1))
                    lists = [leaf[i:j].astype("<i4").tobytes() for i, j in zip(edges, edges[1:])]
                    raw = [v.tobytes() for v in x.astype(kind)]
                    at = row.tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaf.astype(np.int32)), pa.array(rep[own][row]), pa.array(copies[own][row]), pa.array([raw[i] for i in at], pa.binary()), pa.array([lists[i] for i in at], pa.binary())],
                        ["leaf", "rep", "copies", "raw", "leaves"],
                    )

        return classes.select("label", "dim", "rep", "copies", "vector").mapInArrow(run, "leaf int, rep long, copies long, raw binary, leaves binary")

    def _compare(self, routed: DataFrame, kind: str) -> DataFrame:
        """(rep, links, other): vectors that a class links with, by leaf, and a spanning forest of the links."""
        block, threshold = self.block, self.threshold
        # Leaves are split by their size; a hash deals their classes to blocks.
        sizes = routed.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
        dealt = routed.join(sizes, "leaf").withColumn("own", own).withColumn("p", F.explode(pairs)).select("leaf", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "own", "rep", "copies", "raw", "leaves")

        def run(group: pa.Table) -> pa.Table:
            leaf, i, j = (group.column(c)[0].as_py() for c in ("leaf", "i", "j"))
            own, rep, copies = (group.column(c).to_numpy() for c in ("own", "rep", "copies"))
            x = unit(np.frombuffer(b"".join(group.column("raw").to_pylist()), kind).astype(float).reshape(len(rep), -1))
            lists = [np.frombuffer(v, "<i4") for v in group.column("leaves").to_pylist()]
            # Earlier leaves of each row, as bits.
            at, before = np.repeat(np.arange(len(rep)), list(map(len, lists))), np.concatenate(lists)
            at, before = at[before < leaf], before[before < leaf]
            places, place = np.unique(before, return_inverse=True)
            earlier = np.zeros((len(rep), len(places) // 64 + 1), np.uint64)
            np.bitwise_or.at(earlier, (at, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
            label = np.arange(len(rep))
            links, root = np.zeros(len(rep), np.int64), list(range(len(rep)))

            def find(k: int) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            edges = []
            for at in range(0, len(rep), 512):
                a, b = np.nonzero(x[at : at + 512] @ x.T >= threshold - 1e-9)
                a += at
                keep = (rep[a] < rep[b]) & ((i == j) | (own[a] != own[b]))
                a, b = a[keep], b[keep]
                for part in range(0, len(a), 65536):
                    pa_, pb = a[part : part + 65536], b[part : part + 65536]
                    first = (x[pa_] * x[pb]).sum(1) >= threshold
                    first &= ~(earlier[pa_] & earlier[pb]).any(1)
                    pa_, pb = pa_[first], pb[first]
                    np.add.at(links, pa_, copies[pb])
                    np.add.at(links, pb, copies[pa_])
                    apart = label[pa_] != label[pb]
                    for u, v in zip(pa_[apart].tolist(), pb[apart].tolist()):
                        u, v = find(u), find(v)
                        if u != v:
                            root[v] = u
                            edges.append((u, v))
                    if apart.any():
                        label = np.array([find(k) for k in range(len(rep))])
            some = np.flatnonzero(links)
            u, v = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
            return pa.table([pa.array(np.concatenate([rep[some], rep[u]])), pa.concat_arrays([pa.array(links[some]), pa.nulls(len(u), pa.int64())]), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(rep[v])])], ["rep", "links", "other"])

        return dealt.groupBy("leaf", "i", "j").applyInArrow(run, "rep long, links long, other long")

    def components(self, table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
        """(vec_id, n_links, component_id, kept) for every row."""
        spark = table.sparkSession
        store = common.Scratch(spark, "forest")
        kind = "<f4" if dict(table.dtypes)[vector_column] == "array<float>" else "<f8"  # single numbers travel as such, and are compared as doubles
        vector = F.transform(F.col(vector_column).cast("array<double>"), lambda v: v + F.lit(0.0))  # one zero, not two
        rows = table.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector"), _comparable(table, label_column).alias("label"))
        finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("vector", lambda v: v != 0), F.lit(False))
        # Two hashes of label and vector, 128 bits, name a class.
        keyed = rows.withColumn("usable", usable).select(
            "vec_id", "label", "vector", "usable", F.when(F.col("usable"), F.xxhash64("label", "vector")).alias("k1"), F.when(F.col("usable"), F.xxhash64(F.lit(7), "vector", "label")).alias("k2")
        )
        good = keyed.where("usable")
        classes = good.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"), F.first("label").alias("label"))
        # A class goes by a hash of its own, as its ids may all be null.
        classes = store.write(classes.withColumn("rep", F.xxhash64("k1", "k2")).withColumn("dim", F.size("vector")), "classes")
        compared = store.write(self._compare(self._route(classes, self.fit(classes), kind), kind), "compared")
        links = compared.where("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
        label = stars(compared.where("other is not null"), "rep", "other").select(F.col("node").alias("rep"), F.col("component").alias("root"))
        of_class = classes.select("k1", "k2", "copies", "rep", "least").join(links, "rep", "left").join(label, "rep", "left").select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"), "least")
        named = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
        of_class = of_class.join(named, "root").select("k1", "k2", "n_links", "component_id")
        linked = good.select("vec_id", "k1", "k2").join(of_class, ["k1", "k2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        alone = keyed.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def near_duplicates(table: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) with production parameters."""
    return Forest(threshold).components(table)
