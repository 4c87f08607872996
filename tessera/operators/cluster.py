"""Quantisers and clusterings: growing neural gas, agglomerative trees, k-means, density and centroid classifiers.

The sequential kernels (gas, agglomeration by centroids) run as one task over a bounded
input: a sample or a node table, whose size is checked.  All else is distributed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.kernels import _directions, between, to_rows
from ..functions.vectors import finite, metric, squared_euclid
from . import trees
from .assign import centroids, moved_centres, nearest
from .graph import components

# --- growing neural gas ----------------------------------------------------------


@dataclass
class Gas:
    """Parameters of the growing neural gas."""

    max_nodes: int = 1000
    toward_winner: float = 0.2
    toward_neighbour: float = 0.006
    max_age: int = 50
    every: int = 100
    split_error: float = 0.5
    decay: float = 0.995


class GasState:
    """A gas as it grows: positions, errors with the step at which they were true, and aged edges."""

    def __init__(self, gas: Gas, start: np.ndarray):
        self.gas, self.step = gas, 0
        self.pos = np.zeros((max(16, gas.max_nodes), start.shape[1]))
        self.alive = np.zeros(len(self.pos), bool)
        self.error, self.seen = np.zeros(len(self.pos)), np.zeros(len(self.pos), np.int64)
        self.edges: list[dict[int, int]] = [{} for _ in self.pos]
        for i, p in enumerate(start[:2]):
            self.pos[i], self.alive[i] = p, True
        self._tie(0, 1)

    def _tie(self, a: int, b: int) -> None:
        self.edges[a][b] = self.edges[b][a] = 0

    def _cut(self, a: int, b: int) -> None:
        del self.edges[a][b], self.edges[b][a]
        for n in (a, b):
            if not self.edges[n]:
                self.alive[n] = False

    def _now(self, n) -> np.ndarray:
        return self.error[n] * self.gas.decay ** (self.step - self.seen[n])

    def learn(self, x: np.ndarray) -> None:
        """One sample: move the winner and its neighbours, age edges, and grow at times."""
        self.step += 1
        live = np.flatnonzero(self.alive)
        d = ((self.pos[live] - x) ** 2).sum(1)
        first, second = np.argpartition(d, 1)[:2] if len(live) > 2 else np.argsort(d)[:2]
        if (d[second], second) < (d[first], first):
            first, second = second, first
        win, next_best = int(live[first]), int(live[second])
        for n in self.edges[win]:
            self.edges[win][n] += 1
            self.edges[n][win] += 1
        self.error[win], self.seen[win] = self._now(win) + d[first], self.step
        self.pos[win] += self.gas.toward_winner * (x - self.pos[win])
        for n in self.edges[win]:
            self.pos[n] += self.gas.toward_neighbour * (x - self.pos[n])
        self._tie(win, next_best)
        for n in [n for n, age in self.edges[win].items() if age > self.gas.max_age]:
            self._cut(win, n)
        if self.step % self.gas.every == 0:
            self.grow()

    def grow(self) -> None:
        """A node between the worst node and its worst neighbour."""
        free = np.flatnonzero(~self.alive)
        if self.alive.sum() >= self.gas.max_nodes or not free.size:
            return
        live = np.flatnonzero(self.alive)
        worst = int(live[np.argmax(self._now(live))])
        around = np.array(sorted(self.edges[worst]))
        other, new = int(around[np.argmax(self._now(around))]), int(free[0])
        self.pos[new], self.alive[new], self.edges[new] = (self.pos[worst] + self.pos[other]) / 2, True, {}
        for n in (worst, other):
            self.error[n], self.seen[n] = self._now(n) * self.gas.split_error, self.step
        self.error[new], self.seen[new] = (self.error[worst] + self.error[other]) / 2, self.step
        self._tie(worst, new)
        self._tie(other, new)
        del self.edges[worst][other], self.edges[other][worst]

    def restore(self, nodes: list[tuple[int, list[float], float, int]], edges: list[tuple[int, int, int]], step: int) -> None:
        """Takes up the state of a stored model."""
        self.alive[:], self.step = False, step
        self.edges = [{} for _ in self.pos]
        for i, at, error, seen in nodes:
            self.pos[i], self.alive[i], self.error[i], self.seen[i] = at, True, error, seen
        for a, b, age in edges:
            self.edges[a][b] = self.edges[b][a] = age

    def nodes(self) -> list[tuple[int, list[float], float, int]]:
        return [(int(i), self.pos[i].tolist(), float(self.error[i]), int(self.seen[i])) for i in np.flatnonzero(self.alive)]

    def links(self) -> list[tuple[int, int, int]]:
        return [(i, j, age) for i in np.flatnonzero(self.alive).tolist() for j, age in sorted(self.edges[i].items()) if i < j]


def fit_gas(samples: DataFrame, v: str, order: str, gas: Gas | None = None, n_samples: int = 100_000, seed: int = 0, iterations: int | None = None, slices: int = 1, start: DataFrame | None = None) -> DataFrame:
    """(kind, a, b, age, pos, error, last): nodes and edges of a gas fitted to at most ``n_samples`` rows, and a row of kind meta whose ``last`` counts the steps.

    Rows are drawn and ordered by a hash of ``order`` and the seed, in Spark; the
    kernel sees them in that order.  ``samples`` x dimension numbers reach one task.
    ``iterations`` draws so many of them with replacement, in ``slices`` that each
    replay the same draw, instead of taking each row once.  ``start`` is a model
    of an earlier call, from which the fit goes on.
    """
    gas = gas or Gas()
    before = [tuple(r) for r in start.select("kind", "a", "b", "age", "pos", "error", "last").collect()] if start is not None else []  # as many rows as a gas has nodes and edges
    rows = samples.count()
    mark = F.xxhash64(F.col(order), F.lit(seed))
    drawn = samples.where(F.pmod(mark, F.lit(1_000_003)) < min(1.0, n_samples / max(1, rows)) * 1_000_003).select(mark.alias("m"), F.col(v).alias("v"), F.lit(0).alias("g"))

    def run(group: pa.Table) -> pa.Table:
        at = np.argsort(group.column("m").to_numpy(), kind="stable")
        x = np.array(group.column("v").to_pylist(), float)[at]
        if len(x) < 2:
            return pa.table([pa.array([], f.type) for f in _GAS], schema=_GAS)
        state, rest = GasState(gas, x), x[2:]
        if before:
            state.restore([(r[1], *r[4:]) for r in before if r[0] == "node"], [r[1:4] for r in before if r[0] == "edge"], max(r[6] for r in before if r[0] != "edge"))
            rest = x
        if iterations is not None:
            rest = x[np.tile(np.random.default_rng(seed).integers(0, len(x), max(1, iterations // slices)), slices)]
        for row in rest:
            state.learn(row)
        nodes, links = state.nodes(), state.links()
        gap = lambda n: [None] * n
        return pa.table([
            ["node"] * len(nodes) + ["edge"] * len(links) + ["meta"], [n[0] for n in nodes] + [e[0] for e in links] + [None], gap(len(nodes)) + [e[1] for e in links] + [None], gap(len(nodes)) + [e[2] for e in links] + [None],
            [n[1] for n in nodes] + gap(len(links)) + [None], [n[2] for n in nodes] + gap(len(links)) + [None], [n[3] for n in nodes] + gap(len(links)) + [state.step],
        ], schema=_GAS)

    return drawn.groupBy("g").applyInArrow(run, "kind string, a int, b int, age int, pos array<double>, error double, last long")


_GAS = pa.schema([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("age", pa.int32()), ("pos", pa.list_(pa.float64())), ("error", pa.float64()), ("last", pa.int64())])


def gas_components(model: DataFrame) -> DataFrame:
    """(node, component) of a fitted gas."""
    return components(model.where("kind = 'node'").select(F.col("a").cast("long").alias("node")), model.where("kind = 'edge'").select(F.col("a").cast("long").alias("src"), F.col("b").cast("long").alias("dst")))


def edge_coordinates(model: DataFrame) -> DataFrame:
    """(a, b, at): both ends' positions of each edge, one after the other."""
    nodes = model.where("kind = 'node'").select("a", "pos")
    edges = model.where("kind = 'edge'").select("a", "b")
    return edges.join(nodes, "a").join(nodes.select(F.col("a").alias("b"), F.col("pos").alias("pos_b")), "b").select("a", "b", F.concat("pos", "pos_b").alias("at"))


# --- agglomerative clustering -----------------------------------------------------


def _distances(name: str, x: np.ndarray, y: np.ndarray, bands: int) -> np.ndarray:
    """Distances of one vector to rows; none is infinite distance."""
    d = to_rows(name, x, y, bands)
    return np.where(np.isnan(d), np.inf, d)


#: Nodes up to which agglomeration by centroids keeps all distances.
DENSE = 4_000


def agglomerate(x: np.ndarray, distance: str = "euclidean", bands: int = 4, linkage: str = "centroid") -> list[tuple[int, int, int, float, int, np.ndarray]]:
    """Merges (id < 0, left, right, distance, size, centroid) of the closest pair, again and again; ties by place.

    Centroids weigh leaves equally; ``average`` and ``complete`` linkage update distances instead.
    """
    n = len(x)
    names, size, centre = list(range(n)), np.ones(n), np.array(x, float)
    d = np.full((n, n), np.inf)
    for i in range(n):
        d[i, i + 1 :] = d[i + 1 :, i] = _distances(distance, centre[i], centre[i + 1 :], bands)
    best = d.argmin(1) if n else np.empty(0, int)
    live, merges = np.ones(n, bool), []
    for step in range(n - 1):
        rows = np.flatnonzero(live)
        i = int(rows[np.argmin(d[rows, best[rows]])])
        j = int(best[i])
        i, j = (min(i, j), max(i, j)) if d[i, j] < np.inf else rows[:2].tolist()  # without any distance: by place
        gap, si, sj = float(d[i, j]), size[i], size[j]
        centre[i] = (si * centre[i] + sj * centre[j]) / (si + sj)
        live[j] = False
        others = np.flatnonzero(live & (np.arange(n) != i))
        if linkage == "centroid":
            new = _distances(distance, centre[i], centre[others], bands) if others.size else np.empty(0)
        elif linkage == "average":
            new = (si * d[i, others] + sj * d[j, others]) / (si + sj)
        else:
            new = np.maximum(d[i, others], d[j, others])
        size[i] = si + sj
        merges.append((-(step + 1), names[i], names[j], gap, int(size[i]), centre[i].copy()))
        names[i] = -(step + 1)
        d[j], d[:, j] = np.inf, np.inf
        d[i, others] = d[others, i] = new
        if others.size:
            stale = others[(best[others] == i) | (best[others] == j)]
            best[stale] = d[stale].argmin(1)
            closer = others[new < d[others, best[others]]]
            best[closer] = i
            best[i] = int(d[i].argmin())
    return merges


class _Directions:
    """Rows under a metric of directions.  Products in single precision name what may be nearest; its distances are then taken in double precision."""

    def __init__(self, x: np.ndarray, distance: str, bands: int):
        self.centred = distance != "cosine"
        self.first = np.arange(bands) * x.shape[1] // bands if distance == "pspearson" else np.empty(0, int)
        self.unit, self.heads = _directions(x, self.centred), x[:, self.first]
        self.mute = np.isnan(self.unit).any(1)
        self.single = np.where(self.mute[:, None], 0, self.unit).astype(np.float32)
        self.slack = 4 * (8 + x.shape[1]) * 2.0**-24  # twice what a product may be off

    def move(self, i: int, v: np.ndarray) -> None:
        self.unit[i], self.heads[i] = _directions(v[None], self.centred)[0], v[self.first]
        self.mute[i] = np.isnan(self.unit[i]).any()
        self.single[i] = 0 if self.mute[i] else self.unit[i]

    def drop(self, i: int) -> None:
        self.mute[i] = True

    def keep(self, kept: np.ndarray) -> None:
        self.unit, self.single, self.heads, self.mute = self.unit[kept], self.single[kept], self.heads[kept], self.mute[kept]

    def products(self, rows: np.ndarray) -> np.ndarray:
        """Cosines of rows in single precision with all; -inf where there is none."""
        g = rows @ self.single.T
        g[:, self.mute] = -np.inf
        return g

    def _far(self, heads: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.abs(self.heads[at] - heads) > 0.2

    def rough(self, g: np.ndarray, heads: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 - g[at] + 0.2 * self._far(heads, at).sum(1) if len(heads) else 1 - g[at].astype(float)

    def exact(self, unit: np.ndarray, heads: np.ndarray, at: np.ndarray) -> np.ndarray:
        d = 1 - self.unit[at] @ unit
        if len(heads):
            for far in self._far(heads, at).T:  # one after the other, as ``between`` adds
                d += 0.2 * far
        return d

    def nearest(self, g: np.ndarray, unit: np.ndarray, heads: np.ndarray) -> tuple[int, float]:
        """(place, distance) of the nearest row, the first of equal ones, by its products."""
        top = g.argmax(keepdims=True)
        if g[top[0]] == -np.inf:
            return 0, np.inf
        least = self.rough(g, heads, top)[0]
        if least > 1 - g[top[0]] + 0.1:  # others may be nearer
            some = np.flatnonzero(g > g[top[0]] - 0.05)
            least = min(least, self.rough(g, heads, some).min())
        at = np.flatnonzero(g >= 1 - least - self.slack)
        if len(at) > 32:
            d = self.rough(g, heads, at)
            at = at[d <= d.min() + self.slack]
        d = self.exact(unit, heads, at)
        k = d.argmin()
        return int(at[k]), float(d[k])


_DIRECTED = ("cosine", "pearson", "pspearson")


def _nearest_others(x: np.ndarray, y: np.ndarray, same: Callable[[slice, slice], np.ndarray], distance: str, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of each row's nearest row of y, the first of equal ones, without those that are the same; by tiles that stay in a cache."""
    best, gap = np.zeros(len(x), int), np.full(len(x), np.inf)
    for begin in range(0, len(x), 64):
        mine = slice(begin, begin + 64)
        for at in range(0, len(y), 2048):
            other = slice(at, at + 2048)
            d = between(distance, x[mine], y[other], bands)
            d[np.isnan(d) | same(mine, other)] = np.inf
            found = d.argmin(1)
            near = d[np.arange(len(d)), found]
            closer = near < gap[mine]
            best[mine][closer], gap[mine][closer] = at + found[closer], near[closer]
    return best, gap


def _nearest_directions(x: np.ndarray, y: np.ndarray, same: np.ndarray, distance: str, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_nearest_others`` for metrics of directions; ``same`` is each row's own place in y, or -1."""
    mine, others = (_Directions(v, distance, bands) for v in (x, y))
    best, gap = np.zeros(len(x), int), np.full(len(x), np.inf)
    for begin in range(0, len(x), 64):
        g = others.products(mine.single[begin : begin + 64])
        for row, i in zip(g, range(begin, len(x))):
            if same[i] >= 0:
                row[same[i]] = -np.inf
            if not mine.mute[i]:
                best[i], gap[i] = others.nearest(row, mine.unit[i], mine.heads[i])
    return best, gap


def _closest(nodes: DataFrame, n: int, distance: str, bands: int, block: int = 8_192) -> DataFrame:
    """(node, v, g, other, gap): each node's nearest other one, by blocks of nodes against blocks."""
    blocks = -(-n // block)
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    numbered = nodes.select("node", "v", F.pmod(F.xxhash64("node"), F.lit(blocks)).alias("k"))
    left = numbered.select("node", "v", F.col("k").alias("a"), each.alias("b")).repartition(blocks * blocks, "a", "b")
    right = numbered.select("node", "v", each.alias("a"), F.col("k").alias("b")).repartition(blocks * blocks, "a", "b")

    def run(mine: pa.Table, others: pa.Table) -> pa.Table:
        if not (mine.num_rows and others.num_rows):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["node", "other", "gap"])
        others = others.sort_by("node")
        ids, theirs = mine.column("node").to_numpy(), others.column("node").to_numpy()
        x, y = _rows_of(mine, "v"), _rows_of(others, "v")
        if distance in _DIRECTED:
            place, gap = _nearest_directions(x, y, np.where(theirs[at := np.minimum(np.searchsorted(theirs, ids), len(theirs) - 1)] == ids, at, -1), distance, bands)
        else:
            place, gap = _nearest_others(x, y, lambda i, j: ids[i, None] == theirs[j], distance, bands)
        return pa.table([ids, theirs[place], gap], ["node", "other", "gap"])

    met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(run, "node long, other long, gap double").where(F.col("gap") < float("inf"))
    best = met.groupBy("node").agg(F.min(F.struct("gap", "other")).alias("m"))
    return nodes.join(best, "node", "left").select("node", "v", "g", F.coalesce("m.other", "node").alias("other"), F.coalesce("m.gap", F.lit(float("inf"))).alias("gap"))


def _rows_of(table: pa.Table, name: str) -> np.ndarray:
    v = table.column(name).combine_chunks()
    if v.null_count or len(np.unique(v.value_lengths())) > 1:
        raise ValueError("nodes without a vector, or vectors of several lengths")
    return v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)


def agglomerate_centroids(x: np.ndarray, distance: str = "euclidean", bands: int = 4, nearest: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, distance, size, centroid) of the merges -1, -2, ... of ``agglomerate`` by centroids, without a matrix of distances.

    Each cluster keeps its nearest one.  When that is merged, its distance stays as a lower bound, and the
    nearest is only looked for again when the bound is the least of all.  So memory grows with the
    vectors, and time with their number times the rows that a merge compares.  ``nearest`` gives the first nearest places and distances.
    """
    n = len(x)
    names, size, centre = np.arange(n), np.ones(n), np.array(x, float)
    seen = _Directions(centre, distance, bands) if distance in _DIRECTED else None
    exact, live = np.ones(n, bool), np.ones(n, bool)
    places = np.arange(n)
    if nearest is None and seen is not None:
        nearest = _nearest_directions(centre, centre, places, distance, bands)
    best, gap = nearest or _nearest_others(centre, centre, lambda i, j: places[i, None] == places[j], distance, bands)

    def to_all(i: int) -> np.ndarray:
        d = to_rows(distance, centre[i], centre, bands)
        d[np.isnan(d) | ~live] = np.inf
        d[i] = np.inf
        return d

    def look(i: int) -> np.ndarray:
        """Finds the nearest of i; returns distances, or else products, with all."""
        if seen is None:
            d = to_all(i)
            best[i] = d.argmin()
            gap[i], exact[i] = d[best[i]], True
            return d
        g = seen.products(seen.single[i : i + 1])[0]
        g[i] = -np.inf
        if seen.mute[i]:
            g[:] = -np.inf
        best[i], gap[i] = seen.nearest(g, seen.unit[i], seen.heads[i])
        exact[i] = True
        return g

    def look_again() -> None:
        """Finds the nearest of those whose bounds are the least, together: one product costs hardly more than one row's."""
        some = np.flatnonzero(~exact & live)
        if len(some) > 8:
            some = some[np.argpartition(gap[some], 8)[:8]]
        for i, g in zip(some, seen.products(seen.single[some])):
            g[i] = -np.inf
            best[i], gap[i] = seen.nearest(g, seen.unit[i], seen.heads[i]) if not seen.mute[i] else (0, np.inf)
            exact[i] = True

    left, right, at, sizes, centroids = (np.empty(max(0, n - 1), kind) for kind in (np.int64, np.int64, float, np.int64, (float, centre.shape[1:])))
    for step in range(n - 1):
        while True:
            i = int(gap.argmin())
            if exact[i] or gap[i] == np.inf:
                break
            look(i) if seen is None else look_again()
        least = gap[i]
        i, j = sorted((i, int(best[i]))) if least < np.inf else np.flatnonzero(live)[:2].tolist()  # without any distance: by place
        si, sj = size[i], size[j]
        centre[i] = (si * centre[i] + sj * centre[j]) / (si + sj)
        size[i] = si + sj
        live[j], gap[j] = False, np.inf
        left[step], right[step], at[step], sizes[step], centroids[step] = names[i], names[j], least, size[i], centre[i]
        names[i] = -(step + 1)
        exact[(best == i) | (best == j)] = False
        if seen is None:
            d = look(i)
            closer = np.flatnonzero(d < gap)
            d = d[closer]
        else:
            seen.drop(j)
            seen.move(i, centre[i])
            g = look(i)
            closer = np.flatnonzero(g > (1 - seen.slack) - gap)
            closer = closer[seen.rough(g, seen.heads[i], closer) < gap[closer] + seen.slack]
            d = seen.exact(seen.unit[i], seen.heads[i], closer)
            closer, d = closer[d < gap[closer]], d[d < gap[closer]]
        best[closer], gap[closer], exact[closer] = i, d, True
        if 8 * (n - step - 1) < 7 * len(live):  # an eighth of the rows are gone
            kept, place = np.flatnonzero(live), np.cumsum(live) - 1
            names, size, centre, gap, exact, best = names[kept], size[kept], centre[kept], gap[kept], exact[kept], place[best[kept]]
            live = live[kept]
            if seen is not None:
                seen.keep(kept)
    return left, right, at, sizes, centroids


def hac(nodes: DataFrame, v: str, node: str = "node", distance: str = "euclidean", bands: int = 4, linkage: str = "centroid", most: int | None = None) -> DataFrame:
    """(id, left, right, distance, size, centroid) of a node table.

    More than ``most`` nodes are an error; by default that is 20,000 for average and complete linkage, whose
    kernel keeps all distances, and any number for centroids: beyond ``DENSE`` nodes they take memory as the vectors do.
    """
    n = nodes.count()
    if linkage not in ("centroid", "average", "complete"):
        raise ValueError(f"unknown linkage {linkage!r}")
    if most is None and linkage != "centroid":
        most = 20_000
    if most is not None and n > most:
        raise ValueError(f"{n} nodes; agglomeration takes {most} in one task: quantise first")
    lean = linkage == "centroid" and n > DENSE

    def run(group: pa.Table) -> pa.Table:
        at = np.argsort(group.column("node").to_numpy(), kind="stable")
        ids = group.column("node").to_numpy()[at]
        x = _rows_of(group, "v")[at]
        if lean:
            known = np.searchsorted(ids, group.column("other").to_numpy()[at]), group.column("gap").to_numpy()[at].copy()
            left, right, gaps, sizes, centroids = agglomerate_centroids(x, distance, bands, known if len(np.unique(ids)) == len(ids) else None)
        else:
            merges = agglomerate(x, distance, bands, linkage)
            left, right, gaps, sizes = (np.array([m[k] for m in merges], kind) for k, kind in ((1, np.int64), (2, np.int64), (3, float), (4, np.int64)))
            centroids = np.array([m[5] for m in merges], float)
        name = lambda k: pa.array(np.where(k >= 0, ids[np.maximum(k, 0)], k), pa.int64())
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(left) + 1) * x.shape[1], pa.int32()), pa.array(centroids.reshape(-1), pa.float64()))
        return pa.table([pa.array(-1 - np.arange(len(left)), pa.int64()), name(left), name(right), pa.array(gaps, pa.float64()), pa.array(sizes, pa.int32()), vectors], ["id", "left", "right", "distance", "size", "centroid"])

    rows = nodes.select(F.col(node).cast("long").alias("node"), F.col(v).alias("v"), F.lit(0).alias("g"))
    if lean:
        rows = _closest(rows, n, distance, bands)
    return rows.groupBy("g").applyInArrow(run, "id long, left long, right long, distance double, size int, centroid array<double>")


def roots(merges: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(threshold, node, root) for each leaf: the topmost cluster above it whose own distance is under the threshold, else itself."""
    return trees.cut(merges, thresholds)


def tree_shape(merges: DataFrame) -> DataFrame:
    """(id, height, depth) of each merge: the number of its leaves, and the largest sum of distances from it down to a leaf.

    Distances are added from the merge downwards, so equal paths have equal sums whatever hangs beside them.
    """
    return trees.shape(merges)


def sweep(merges: DataFrame, spark: SparkSession, start: float = 1.0, step: float = 0.005, end: float = 0.01) -> DataFrame:
    """(threshold, n_clusters, largest, mean_size) for thresholds from start down to end."""
    count = int(round((start - end) / step)) + 1
    thresholds = spark.range(count).select((F.lit(start) - F.col("id") * step).alias("threshold")).where(F.col("threshold") > end)
    return trees.swept(merges, thresholds)


#: How the clusters of a cut are numbered: by their smallest leaf, by their root (the latest merge first), or by the smallest component of their leaves.
LABEL_RULES = ("first_leaf", "root", "component")


def labels_of(cut: DataFrame, rule: str = "first_leaf", components_of: DataFrame | None = None) -> DataFrame:
    """Adds ``label`` by a rule of LABEL_RULES; ``component`` takes the component (node, component) of each cluster's smallest leaf, and so may repeat."""
    if rule not in LABEL_RULES:
        raise ValueError(f"unknown rule {rule!r}; there are {LABEL_RULES}")
    first = cut.groupBy("threshold", "root").agg(F.min("node").alias("first"))
    if rule == "component":
        of = components_of.select(F.col("node").alias("first"), F.col("component").alias("label"))
        return cut.join(first.join(of, "first", "left").drop("first"), ["threshold", "root"])
    by = Window.partitionBy("threshold").orderBy("first" if rule == "first_leaf" else "root")
    return cut.join(first.withColumn("label", F.row_number().over(by) - 1).drop("first"), ["threshold", "root"])


# --- other clusterings -------------------------------------------------------------


def kmeans(points: DataFrame, k: int, rounds: int, point_id: str, v: str, dim: int) -> DataFrame:
    """(point_id, cid, dist) after Lloyd rounds from the k points with the smallest ids; an empty centre stays where it is.

    A round is one scan in which tasks add up the points nearest to each centre.
    Vectors of another length, or with a null, NaN or infinite component, take no part and have no row.
    """
    points = points.where((F.size(v) == dim) & finite(v))
    at = points.orderBy(point_id).limit(k).select(point_id, v).collect()
    centres = {i: list(r[1]) for i, r in enumerate(at)}
    spark = points.sparkSession
    frame = lambda: spark.createDataFrame([(i, [float(x) for x in c]) for i, c in centres.items()], "cid long, centre array<double>")
    for _ in range(rounds if centres else 0):
        centres |= {r["cid"]: r["centre"] for r in moved_centres(points, frame(), v, dim).collect()}  # k rows
    return nearest(points, frame(), "squared_euclid", point_id, v)


def within(points: DataFrame, point_id: str, v: str, eps: float, distance: str = "euclidean", axes: int = 3) -> DataFrame:
    """(src, dst): ordered pairs of different points at a Euclidean distance up to eps.

    Such points are at most eps apart on every axis, so cells of that width on the
    first ``axes`` of them give candidates by an equi-join, each pair once.
    """
    if distance not in ("euclidean", "squared_euclid"):
        raise ValueError("cells need a Euclidean distance")
    d = metric(distance)
    axis = lambda i: F.coalesce(F.floor(F.get(v, F.lit(i)) / F.lit(eps if distance == "euclidean" else eps**0.5)), F.lit(0)).cast("long")
    base = points.select(F.col(point_id).alias("k"), F.col(v).alias("w"), *(axis(i).alias(f"c{i}") for i in range(axes)))
    left = base.select(F.col("k").alias("a"), F.col("w").alias("u"), *(f"c{i}" for i in range(axes)), _halves(axes).alias("s"))
    left = left.select("a", "u", F.col("s.own").alias("own"), *((F.col(f"c{i}") + F.col(f"s.s{i}")).alias(f"c{i}") for i in range(axes)))
    met = left.join(base, [f"c{i}" for i in range(axes)]).where((~F.col("own") | (F.col("a") < F.col("k"))) & (d(F.col("u"), F.col("w")) <= eps))
    once = met.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("k").alias("dst")), F.struct(F.col("k").alias("src"), F.col("a").alias("dst")))).alias("p"))
    return once.select("p.src", "p.dst")


def _halves(axes: int) -> Column:
    """Steps (s0, s1, ..., own) from a cell to itself and to one of each two opposite cells around it."""
    halves = [s for s in product((-1, 0, 1), repeat=axes) if s >= (0,) * axes]
    return F.explode(F.array(*(F.struct(*(F.lit(x).alias(f"s{i}") for i, x in enumerate(s)), F.lit(not any(s)).alias("own")) for s in halves)))


#: Components, and cells from the origin, up to which rounding can't part a cell's points by more than the radius; points beyond are cells of their own.
_CELL_DIM, _CELL_PLACE = 500, 1 << 30


def _box(column: str, axes: int) -> list[Column]:
    """Aggregates l0, h0, l1, ...: what the first axes span; an axis that a vector doesn't have is at 0."""
    at = [F.coalesce(F.get(column, F.lit(i)), F.lit(0.0)) for i in range(axes)]
    return [f(x).alias(f"{name}{i}") for i, x in enumerate(at) for name, f in (("l", F.min), ("h", F.max))]


def _boxes_near(a: str, b: str, axes: int, width: float) -> Column:
    """Whether the boxes of a and b lie within the width of each other, or nearly."""
    apart = lambda i: F.greatest(F.col(f"{a}.l{i}") - F.col(f"{b}.h{i}"), F.col(f"{b}.l{i}") - F.col(f"{a}.h{i}"), F.lit(0.0))
    return sum((apart(i) * apart(i) for i in range(axes)), F.lit(0.0)) <= width * width * (1 + 1e-9)


def _meet(x: np.ndarray, y: np.ndarray, eps: float, root: bool) -> bool:
    """Whether some row of x and some row of y are at a distance up to eps; boxes that are halved rule out the rest."""
    todo = [(x, y)]
    while todo:
        x, y = todo.pop()
        away = np.maximum(0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
        gap = (away * away).sum()
        if (np.sqrt(gap) if root else gap) > eps * (1 + 1e-9):
            continue
        if len(x) * len(y) <= 1 << 16:
            d = np.zeros((len(x), len(y)))
            for u, w in zip(x.T, y.T):  # one after the other, as the expression adds
                d += (u[:, None] - w) ** 2
            if ((np.sqrt(d) if root else d) <= eps).any():
                return True
            continue
        one, other = (x, y) if len(x) >= len(y) else (y, x)
        axis = (one.max(0) - one.min(0)).argmax()
        order = np.argpartition(one[:, axis], len(one) // 2)
        parts = [one[order[: len(one) // 2]], one[order[len(one) // 2 :]]]
        parts.sort(key=lambda p: -abs(p[:, axis].mean() - other[:, axis].mean()))  # the nearer half is looked at first
        todo += [(p, other) for p in parts]
    return False


def _linked_cells(cores: DataFrame, touching: DataFrame, eps: float, width: float, distance: str, axes: int) -> DataFrame:
    """(cell, component) of cells with cores (node, v, cell): cells are linked where a core of one is near a core of the other; named by the smallest core.

    The outermost cores of two cells settle most pairs of cells.  Of the others only those are looked into whose
    cells aren't connected anyway, with the cores that are near the other cell's box.
    """
    d = metric(distance)
    at = [F.get("v", F.lit(i)) for i in range(axes)]
    ends = F.array_distinct(F.array_compact(F.array(*(f("v", x) for x in at for f in (F.min_by, F.max_by)))))
    cells = cores.groupBy("cell").agg(F.min("node").alias("name"), F.count("*").alias("k"), ends.alias("ends"), *_box("v", axes)).checkpoint()
    met = touching.join(cells.alias("p"), F.col("a") == F.col("p.cell")).join(cells.alias("q"), F.col("b") == F.col("q.cell")).where(_boxes_near("p", "q", axes, width))
    near = F.exists("p.ends", lambda u: F.exists("q.ends", lambda w: F.coalesce(d(u, w) <= eps, F.lit(False))))
    settled = (F.size("p.ends") == F.col("p.k")) & (F.size("q.ends") == F.col("q.k"))
    met = met.select(F.col("p.name").alias("src"), F.col("q.name").alias("dst"), "a", "b", near.alias("near"), settled.alias("settled")).checkpoint()
    names = cells.select(F.col("name").alias("node"))
    found = components(names, met.where("near"))
    of = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"{side}_in"))
    unsure = met.where("not near and not settled").join(of("src"), "src").join(of("dst"), "dst").where("src_in <> dst_in").select("src", "dst", "a", "b").checkpoint()
    if unsure.limit(1).count():

        def sent(mine: str, other: str) -> DataFrame:
            """Cores of one side of each unsure pair that are near the other side's box."""
            box = [f"{name}{i}" for i in range(axes) for name in "lh"]
            rows = unsure.join(cells.select(F.col("cell").alias(other), *box), other).join(cores.select(F.col("cell").alias(mine), "v"), mine)
            apart = [F.greatest(F.col(f"l{i}") - x, x - F.col(f"h{i}"), F.lit(0.0)) for i, x in enumerate(F.coalesce(F.get("v", F.lit(i)), F.lit(0.0)) for i in range(axes))]
            return rows.where(sum((x * x for x in apart), F.lit(0.0)) <= width * width * (1 + 1e-9)).select("src", "dst", "v")

        def run(one: pa.Table, other: pa.Table) -> pa.Table:
            if not (one.num_rows and other.num_rows):
                return pa.table([pa.array([], one.column("src").type)] * 2, ["src", "dst"])
            x, y = (g.column("v").combine_chunks() for g in (one, other))
            x, y = (v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) for v in (x, y))
            some = x.shape[1] == y.shape[1] and _meet(x, y, eps, distance == "euclidean")
            return one.select(["src", "dst"]).slice(0, int(some))

        kind = dict(met.dtypes)["src"]
        more = sent("a", "b").groupBy("src", "dst").cogroup(sent("b", "a").groupBy("src", "dst")).applyInArrow(run, f"src {kind}, dst {kind}")
        found = components(names, met.where("near").select("src", "dst").unionByName(more))
    return cells.join(found, F.col("name") == F.col("node")).select("cell", "component")


def dbscan(points: DataFrame, point_id: str, v: str, eps: float, least: int, distance: str = "euclidean", axes: int = 3) -> DataFrame:
    """(point_id, cluster, core): clusters are named by their smallest core; a border point joins its smallest one, noise is -1.  A point counts itself.

    Space is cut into cells whose points are all within eps of one another.  A cell with ``least`` points holds cores only,
    so only points of the other cells are held against the points around them: fewer than ``least`` for each cell, and no table
    grows with the square of the density.  Cells with cores are linked as ``_linked_cells`` has it.  In many dimensions nearly each point is
    a cell, and the pairs within the radius are made.
    """
    if distance not in ("euclidean", "squared_euclid"):
        raise ValueError("cells need a Euclidean distance")
    every = points.select(F.col(point_id).alias("_id"), F.when(finite(v), F.transform(F.col(v).cast("array<double>"), lambda x: x + 0.0)).alias("_v"))
    # points with equal vectors are one place, named by the smallest; what has no usable vector is near nothing
    places = every.where("_v is not null").groupBy("_v").agg(F.min("_id").alias("node"), F.count("*").alias("n")).where("node is not null").checkpoint()
    axes = min(axes, places.agg(F.max(F.size("_v"))).first()[0] or 1) or 1
    d, width = metric(distance), eps if distance == "euclidean" else max(eps, 0.0) ** 0.5
    parts = F.floor(F.sqrt(F.size("_v"))) + 1  # of the radius on an axis; a cell's diagonal is shorter than the radius
    side = F.lit((width if width > 0 else 1.0) * (1 + 1e-6)) / parts
    cut = places.select("*", F.transform("_v", lambda x: F.floor(x / side)).alias("_at"))
    shared = (F.lit(width > 0)) & (F.size("_v") <= _CELL_DIM) & F.forall("_at", lambda p: F.abs(p) < _CELL_PLACE)
    cut = cut.withColumn("_own", F.when(~shared, F.col("node")))
    named = cut.groupBy(F.col("_at").alias("_in"), F.col("_own").alias("_alone")).agg(F.min("node").alias("cell"), F.sum("n").alias("held"))
    coarse = [F.coalesce(F.floor(F.get("_at", F.lit(i)) / parts), F.lit(0)).alias(f"c{i}") for i in range(axes)]
    placed = cut.join(named, (F.col("_at") == F.col("_in")) & F.col("_own").eqNullSafe(F.col("_alone"))).select("node", F.col("_v").alias("v"), "n", "cell", "held", *coarse).checkpoint()

    grid = [f"c{i}" for i in range(axes)]
    cells = placed.groupBy("cell", *grid).agg(*_box("v", axes)).checkpoint()
    left = cells.withColumn("s", _halves(axes)).select(F.col("cell").alias("a"), F.col("s.own").alias("own"), *(f"{x}{i}" for i in range(axes) for x in "lh"), *((F.col(c) + F.col(f"s.s{i}")).alias(c) for i, c in enumerate(grid)))
    met = left.alias("p").join(cells.alias("q"), [F.col(f"p.{c}") == F.col(f"q.{c}") for c in grid])
    touching = met.where((~F.col("own") | (F.col("a") < F.col("cell"))) & _boxes_near("p", "q", axes, width)).select("a", F.col("cell").alias("b")).checkpoint()

    both = touching.unionByName(touching.select(F.col("b").alias("a"), F.col("a").alias("b")))
    thin = placed.where(F.col("held") < least).select("node", F.col("v").alias("u"), F.col("cell").alias("a"))
    around = placed.select(F.col("node").alias("other"), F.col("v").alias("w"), "n", F.col("cell").alias("b"))
    near = thin.join(both, "a").join(around, "b").where(d(F.col("u"), F.col("w")) <= eps).select("node", "other", "n").checkpoint()
    others = near.groupBy("node").agg(F.sum("n").alias("others"))
    judged = placed.join(others, "node", "left").select("node", "v", "cell", (F.col("held") + F.coalesce("others", F.lit(0)) >= least).alias("core")).checkpoint()

    linked = _linked_cells(judged.where("core").select("node", "v", "cell"), touching, eps, width, distance, axes)
    held = judged.join(linked, "cell", "left")
    border = near.join(held.where("core").select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
    found = held.join(border, "node", "left").select(F.col("v").alias("_v"), F.when(F.col("core"), F.col("component")).alias("component"), F.least("component", "near").alias("near"))
    alone = F.when(F.col("_v").isNull() & F.lit(least <= 1), F.col("_id"))
    rows = every.join(found, "_v", "left").withColumn("component", F.coalesce("component", alone))
    return rows.select(F.col("_id").alias(point_id), F.coalesce("component", "near", F.lit(-1)).alias("cluster"), F.col("component").isNotNull().alias("core"))


def nearest_centroid(train: DataFrame, points: DataFrame, label: str, v: str, dim: int, point_id: str, distance: str = "cosine") -> DataFrame:
    """(point_id, cid, dist): the class whose mean is nearest."""
    return nearest(points, centroids(train, label, v, dim), distance, point_id, v)


__all__ = ["Gas", "GasState", "agglomerate", "dbscan", "edge_coordinates", "fit_gas", "gas_components", "hac", "kmeans", "labels_of", "nearest_centroid", "roots", "squared_euclid", "sweep", "tree_shape", "within"]
