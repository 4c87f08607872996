"""Sums of Euclidean distances from every place to all others, in the line and the plane, without all pairs.

The square around the places is halved on both axes where it holds more than ``leaf`` places.  Seen
from far enough, a cell's places are replaced by weights at ``NODES`` x ``NODES`` Chebyshev points of the cell, and what far
cells add to a leaf is worked out at the leaf's Chebyshev points and interpolated.  A cell is far
where the gap is at least the larger one's side; there both interpolations err by some 1e-13 of the distance, as sums of doubles
do.  Leaves that are not far meet place by place.  Nothing is sampled or left out.

The driver holds the tree: a few numbers for each leaf.  Weights and places move between tasks only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import between

#: Chebyshev points on each axis of a cell.
NODES = 18
#: How often the square may be halved.
DEPTH = 24
_AT = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
_BASIS = np.cos(np.arange(NODES)[:, None] * np.arccos(_AT)) * np.where(np.arange(NODES) == 0, 1, 2)[:, None] / NODES


def _weights(t: np.ndarray) -> np.ndarray:
    """The Lagrange polynomials of the Chebyshev points at places within -1 and 1."""
    return np.cos(np.arccos(np.clip(t, -1, 1))[:, None] * np.arange(NODES)) @ _BASIS


def _name(level, i, j):
    return (level << 56) | (i << 28) | j


def _cell(name: int) -> tuple[int, int, int]:
    return name >> 56, (name >> 28) & ((1 << 28) - 1), name & ((1 << 28) - 1)


class _Square:
    """The square around all places."""

    def __init__(self, low: tuple[float, float], side: float):
        self.low, self.side = np.array(low), side

    def of(self, name: int) -> tuple[np.ndarray, float]:
        """(centre, half of the side) of a cell."""
        level, i, j = _cell(name)
        half = self.side / 2 ** (level + 1)
        return self.low + half * (2 * np.array([i, j]) + 1), half

    def nodes(self, name: int) -> np.ndarray:
        centre, half = self.of(name)
        x, y = np.meshgrid(_AT, _AT, indexing="ij")
        return centre + half * np.stack([x.ravel(), y.ravel()], 1)

    def weights(self, name: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centre, half = self.of(name)
        t = (at - centre) / half
        return _weights(t[:, 0]), _weights(t[:, 1])


def _spread(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights (labels, NODES, NODES) at a cell's points of weights w (places, labels)."""
    return np.stack([x.T @ (y * column[:, None]) for column in w.T])


def _parted(name: int, split: set[int], held: set[int]) -> Iterator[tuple[int, bool]]:
    """(cell, far) of cells that together hold all places, as a leaf takes them; near ones are leaves."""
    level, i, j = _cell(name)
    todo = [_name(0, 0, 0)]
    while todo:
        other = todo.pop()
        depth, a, b = _cell(other)
        # in units of half the side of a cell of the last level: centres and half sides
        mine, theirs = 1 << (DEPTH - level), 1 << (DEPTH - depth)
        gap = max(abs((2 * i + 1) * mine - (2 * a + 1) * theirs), abs((2 * j + 1) * mine - (2 * b + 1) * theirs))
        if gap >= 3 * max(mine, theirs) + min(mine, theirs):
            yield other, True
        elif other in split:
            todo += [n for n in (_name(depth + 1, 2 * a + k, 2 * b + m) for k in (0, 1) for m in (0, 1)) if n in held]
        else:
            yield other, False


def _tree(placed: DataFrame, leaf: int) -> tuple[set[int], set[int]]:
    """(cells that are halved, all cells): a row for each cell reaches the driver."""
    spark = placed.sparkSession
    split, held, large = set(), set(), None
    for level in range(DEPTH + 1):
        at = [F.shiftright(c, DEPTH - level).alias(c) for c in ("i", "j")]
        rows = placed
        if large is not None:
            above = spark.createDataFrame([_cell(n)[1:] for n in large], "pi long, pj long")
            rows = placed.join(F.broadcast(above), (F.shiftright("i", DEPTH - level + 1) == F.col("pi")) & (F.shiftright("j", DEPTH - level + 1) == F.col("pj")), "left_semi")
        counts = rows.groupBy(*at).count().collect()
        held |= {_name(level, r["i"], r["j"]) for r in counts}
        large = [_name(level, r["i"], r["j"]) for r in counts if r["count"] > leaf] if level < DEPTH else []
        split |= set(large)
        if not large:
            return split, held


def distance_sums(places: DataFrame, labels: int, low: tuple[float, float], side: float, leaf: int = 2000) -> DataFrame:
    """(_key, sums): for each place (_key, x, y, w) the distances to all places, added up by label with their weights w (an array of ``labels`` doubles)."""
    spark, square = places.sparkSession, _Square(low, side)
    step = lambda c, least: F.least(F.greatest(F.floor((F.col(c) - least) / side * (1 << DEPTH)), F.lit(0)), F.lit((1 << DEPTH) - 1)).cast("long")
    placed = places.select("_key", "x", "y", "w", step("x", low[0]).alias("i"), step("y", low[1]).alias("j")).checkpoint()
    split, held = _tree(placed, leaf)
    leaves = np.array(sorted(held - split))
    tree = spark.sparkContext.broadcast((split, held))
    lasts = {level: leaves[leaves >> 56 == level] for level in np.unique(leaves >> 56).tolist()}

    def dealt_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
            cell = np.zeros(len(i), np.int64)
            for level, names in lasts.items():
                at = _name(level, i >> (DEPTH - level), j >> (DEPTH - level))
                found = names[np.minimum(np.searchsorted(names, at), len(names) - 1)] == at
                cell[found] = at[found]
            yield pa.RecordBatch.from_arrays([pa.array(cell), *(batch.column(c) for c in ("_key", "x", "y", "w"))], ["cell", "_key", "x", "y", "w"])

    dealt = placed.mapInArrow(dealt_out, "cell long, _key long, x double, y double, w array<double>").checkpoint()
    at = lambda t, names="xy": np.stack([t.column(c).to_numpy() for c in names], 1)
    weight = lambda t: t.column("w").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, labels)

    def weighed(group: pa.Table) -> pa.Table:
        """A leaf's weights, and what they add to the cells above it."""
        name = group.column("cell")[0].as_py()
        level, i, j = _cell(name)
        q = _spread(*square.weights(name, at(group)), weight(group))
        own, flat = square.nodes(name), q.reshape(labels, -1).T
        out = {name: q} | {n: _spread(*square.weights(n, own), flat) for n in (_name(k, i >> (level - k), j >> (level - k)) for k in range(2, level))}
        return pa.table([pa.array(list(out), pa.int64()), pa.array([v.tobytes() for v in out.values()], pa.binary())], ["cell", "q"])

    def added(group: pa.Table) -> pa.Table:
        q = sum(np.frombuffer(v.as_buffer()) for v in group.column("q"))
        return pa.table([group.column("cell").slice(0, 1).combine_chunks(), pa.array([q.tobytes()], pa.binary())], ["cell", "q"])

    q = dealt.groupBy("cell").applyInArrow(weighed, "cell long, q binary").groupBy("cell").applyInArrow(added, "cell long, q binary").checkpoint()

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                found = list(_parted(name, *tree.value))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found])], ["cell", "other", "far"])

    meetings = dealt.select("cell").distinct().mapInArrow(parted, "cell long, other long, far boolean").checkpoint()

    def from_far(group: pa.Table) -> pa.Table:
        name = group.column("cell")[0].as_py()
        mine, out = square.nodes(name), np.zeros((labels, NODES * NODES))
        for other, weights in zip(group.column("other").to_pylist(), group.column("q")):
            out += np.frombuffer(weights.as_buffer()).reshape(labels, -1) @ between("euclidean", square.nodes(other), mine)
        return pa.table([pa.array([name], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["cell", "far"])

    far = meetings.where("far").select("cell", "other").join(q.withColumnRenamed("cell", "other"), "other").groupBy("cell").applyInArrow(from_far, "cell long, far binary")
    near = meetings.where("not far").select(F.col("cell").alias("to"), F.col("other").alias("cell")).join(dealt, "cell").select("to", F.col("x").alias("u"), F.col("y").alias("v"), "w")
    mine = dealt.select("cell", "_key", "x", "y", F.lit(None).cast("binary").alias("far")).unionByName(far, allowMissingColumns=True)

    def summed(own: pa.Table, others: pa.Table) -> pa.Table:
        from_cells = own.filter(pa.compute.is_valid(own.column("far"))).column("far")
        own = own.filter(pa.compute.is_null(own.column("far")))
        here, there, w = at(own), at(others, "uv"), weight(others)
        sums = np.zeros((len(here), labels))
        if len(from_cells):
            x, y = square.weights(own.column("cell")[0].as_py(), here)
            for k, v in enumerate(np.frombuffer(from_cells[0].as_buffer()).reshape(labels, NODES, NODES)):
                sums[:, k] = ((x @ v) * y).sum(1)
        share = max(1, (1 << 17) // max(1, min(len(there), 8192)))
        for begin in range(0, len(here), share):
            for first in range(0, len(there), 8192):
                sums[begin : begin + share] += between("euclidean", here[begin : begin + share], there[first : first + 8192]) @ w[first : first + 8192]
        return pa.table([own.column("_key").combine_chunks(), pa.ListArray.from_arrays(pa.array(np.arange(len(here) + 1) * labels, pa.int32()), pa.array(sums.reshape(-1)))], ["_key", "sums"])

    return mine.groupBy("cell").cogroup(near.groupBy("to")).applyInArrow(summed, "_key long, sums array<double>")
