"""Nearest neighbours among a table of centres.

Centres that fit ``most_values`` numbers travel as one broadcast row, and each
point finds its neighbours in an expression over that array: no shuffle, whatever
the number of points.  More centres are cut into blocks of that size; each point
meets each block once, and the blocks' answers are merged by an aggregate that
combines before its shuffle.  ``matrix`` computes Euclidean and cosine distances
in numpy; ``nearest`` takes it where it can, and for more than ``MANY`` centres the
trees of ``index``, which compare a point with few of them.  In both, vectors with a component that
is null, NaN or infinite have no distance to anything, and no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import NUMPY, between, nearest_rows
from ..functions.vectors import Metric, dot, finite, metric, vector_stats
from .index import METRICS, indexed_neighbours

MOST_VALUES = 2_000_000
#: Centres from which trees take over.
MANY = 2_000


def centroids(points: DataFrame, label: str, v: str, dim: int) -> DataFrame:
    """(cid, centre): the mean vector of each label."""
    return vector_stats(points.where(F.col(label).isNotNull()), v, dim, [label]).select(F.col(label).alias("cid"), F.col("mean").alias("centre"))


def neighbours(points: DataFrame, centres: DataFrame, distance: Metric | str = "squared_euclid", k: int = 1, within: float | None = None, point_id: str = "vec_id", v: str = "v", most_values: int = MOST_VALUES) -> DataFrame:
    """(point_id, rank from 1, cid, dist): the k nearest centres (cid, centre), those nearer than ``within`` only; ties by cid.

    Points whose distances are all null have no row.
    """
    if isinstance(distance, str):
        distance = metric(distance)
    size = centres.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("centre")), F.lit(0)).alias("values")).first()
    blocks = max(1, -(-size["values"] // most_values))
    packed = centres.groupBy(F.pmod(F.xxhash64("cid"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("cid", "centre")).alias("centres"))
    if blocks == 1:
        packed = F.broadcast(packed)
    found = F.transform("centres", lambda c: F.struct(distance(F.col(v), c["centre"]).alias("dist"), c["cid"].alias("cid")))
    found = F.filter(found, lambda f: f["dist"].isNotNull() & (f["dist"] < within if within is not None else F.lit(True)))
    best = F.array(F.array_min(found)) if k == 1 else F.slice(F.array_sort(found), 1, k)
    answers = points.select(point_id, v).crossJoin(packed).select(point_id, best.alias("best"))
    if blocks > 1:
        answers = answers.select(point_id, F.explode("best").alias("b")).groupBy(point_id).agg(F.slice(F.array_sort(F.collect_list("b")), 1, k).alias("best"))
    return answers.select(point_id, F.posexplode("best").alias("rank", "b")).where("b is not null").select(point_id, (F.col("rank") + 1).alias("rank"), "b.cid", "b.dist")


MATRIX = ("squared_euclid", "euclidean", "cosine")


def matrix_neighbours(points: DataFrame, centres: DataFrame, distance: str = "squared_euclid", k: int = 1, within: float | None = None, point_id: str = "vec_id", v: str = "v", most_values: int = MOST_VALUES) -> DataFrame:
    """The same by matrix products in Arrow batches, for Euclidean and cosine distances and centres within ``most_values`` numbers.

    Vectors and centres that are null, hold a null, NaN or infinity, or differ in
    length from the most frequent centre have no distance, and no row if all theirs
    are like that.
    """
    if distance not in MATRIX:
        raise ValueError(f"no matrix form of {distance}")
    if centres.agg(F.coalesce(F.sum(F.size("centre")), F.lit(0))).first()[0] > most_values:
        return neighbours(points, centres, distance, k, within, point_id, v, most_values)
    usable = centres.where(F.col("cid").isNotNull() & finite("centre"))
    rows = sorted(((r["cid"], r["centre"]) for r in usable.select("cid", "centre").collect()), key=lambda r: r[0])
    kinds = dict(points.dtypes)[point_id], dict(centres.dtypes)["cid"]
    lengths = [len(r[1]) for r in rows]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n)) if rows else 0
    ids, at = pa.array([r[0] for r in rows if len(r[1]) == dim]), np.array([r[1] for r in rows if len(r[1]) == dim], float)
    share = max(1, (1 << 21) // max(1, len(at)))  # rows whose distances are held at once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(at):
            return
        for batch in batches:
            for begin in range(0, batch.num_rows, share):
                part = batch.slice(begin, share)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
                if distance == "cosine":
                    with np.errstate(invalid="ignore", divide="ignore"):
                        d = 1 - (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (at / np.linalg.norm(at, axis=1, keepdims=True)).T
                    order = np.argsort(d, axis=1, kind="stable")[:, :k]
                    d = np.take_along_axis(d, order, 1)
                else:
                    order, d = nearest_rows(x, at, k)
                    d = np.sqrt(d) if distance == "euclidean" else d
                n = order.shape[1]
                keys = part.column(0).take(pa.array(np.repeat(np.arange(len(x)), n)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(x))), ids.take(pa.array(order.reshape(-1))), pa.array(d.reshape(-1))], [point_id, "rank", "cid", "dist"])

    whole = points.select(point_id, v).where((F.size(v) == dim) & finite(v))
    found = whole.mapInArrow(run, f"`{point_id}` {kinds[0]}, rank int, cid {kinds[1]}, dist double").where("not isnan(dist)")
    return found.where(F.col("dist") < within) if within is not None else found


def _chosen(points: DataFrame, centres: DataFrame, distance: Metric | str, k: int, point_id: str, v: str) -> DataFrame:
    """The matrix form where a metric has one, or the index for many centres; else the expression."""
    if isinstance(distance, str) and distance in METRICS and centres.limit(MANY + 1).count() > MANY:
        return indexed_neighbours(points, centres, distance, k, point_id=point_id, v=v)
    form = matrix_neighbours if isinstance(distance, str) and distance in MATRIX else neighbours
    return form(points, centres, distance, k, point_id=point_id, v=v)


STRATEGIES = {"best": _chosen, "expression": neighbours, "matrix": matrix_neighbours, "index": indexed_neighbours}


def nearest(points: DataFrame, centres: DataFrame, distance: Metric | str = "squared_euclid", point_id: str = "vec_id", v: str = "v", strategy: str = "best") -> DataFrame:
    """(point_id, cid, dist) of each point's nearest centre."""
    return STRATEGIES[strategy](points, centres, distance, 1, point_id=point_id, v=v).drop("rank")


def moved_centres(points: DataFrame, centres: DataFrame, v: str, dim: int) -> DataFrame:
    """(cid, n, centre): the mean of the points nearest to each centre; tasks send sums, so no vector is shuffled.

    Vectors of another length, or with a null, NaN or infinite component, belong to no centre.
    """
    rows = sorted((r["cid"], r["centre"]) for r in centres.select("cid", "centre").collect())
    at = np.array([r[1] for r in rows], float).reshape(-1, dim)
    share = max(1, (1 << 21) // max(1, len(at)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(at), np.int64), np.zeros(at.shape)
        for batch in batches:
            for begin in range(0, batch.num_rows, share):
                part = batch.slice(begin, share)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                best = nearest_rows(x, at)[0][:, 0]
                n += np.bincount(best, minlength=len(at))
                np.add.at(sums, best, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in some.tolist()], pa.int64()), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.float64()))], ["cid", "n", "sums"])

    whole = points.select(v).where((F.size(v) == dim) & finite(v))
    parts = whole.mapInArrow(run, "cid long, n long, sums array<double>")
    return parts.groupBy("cid").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) / F.sum("n") for i in range(dim))).alias("centre"))


#: Pairs of a task, about, and of an Arrow batch.
TASK_PAIRS, BATCH_PAIRS = 1 << 22, 1 << 16


def distances(points: DataFrame, queries: DataFrame, distance: Metric | str, point_id: str = "vec_id", v: str = "v", most_values: int = MOST_VALUES) -> DataFrame:
    """(a, b, dist) of every query (point_id, v) and every other point; queries travel in blocks of a bounded size.

    A metric by name with a numpy form is taken by blocks of rows against blocks.  Other metrics, and vectors that are not
    finite or differ in length from the most frequent query, go through the expression, pair by pair.
    """
    if isinstance(distance, str) and distance in NUMPY:
        usable = queries.where(F.col(point_id).isNotNull() & finite(v))
        sizes = usable.groupBy(F.size(v).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
        if sizes and sizes[0]["dim"] > 0:
            even = finite(v) & (F.size(v) == sizes[0]["dim"])
            plain = [points.where(even), points.where(~even)], [queries.where(even), queries.where(~even)]
            found = _distances_by_blocks(plain[0][0], plain[1][0], distance, sizes[0]["dim"], sizes[0]["count"], point_id, v, most_values)
            for p, q in ((plain[0][1], queries), (plain[0][0], plain[1][1])):
                if p.limit(1).count() and q.limit(1).count():
                    found = found.unionByName(distances(p, q, metric(distance), point_id, v, most_values))
            return found
    if isinstance(distance, str):
        distance = metric(distance)
    size = queries.agg(F.coalesce(F.sum(F.size(v)), F.lit(0))).first()[0]
    blocks = max(1, -(-size // most_values))
    packed = queries.groupBy(F.pmod(F.xxhash64(point_id), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct(F.col(point_id).alias("a"), F.col(v).alias("q"))).alias("queries")).select("queries")
    met = points.select(F.col(point_id).alias("b"), F.col(v).alias("x")).crossJoin(F.broadcast(packed) if blocks == 1 else packed)
    return met.select("b", "x", F.explode("queries").alias("q")).where("q.a <> b").select("q.a", "b", distance(F.col("q.q"), F.col("x")).alias("dist"))


def _distances_by_blocks(points: DataFrame, queries: DataFrame, distance: str, dim: int, n: int, point_id: str, v: str, most_values: int) -> DataFrame:
    """Pairs of vectors that are all finite and of ``dim`` components; n queries."""
    whole = points.where(F.col(point_id).isNotNull()).select(F.col(point_id).alias("b"), F.col(v).cast("array<double>").alias("x"))
    asked = queries.where(F.col(point_id).isNotNull()).select(F.col(point_id).alias("a"), F.col(v).cast("array<double>").alias("q"))
    blocks = max(1, -(-n * dim // most_values))
    tasks = max(1, -(-whole.count() * -(-n // blocks) // TASK_PAIRS))
    kinds = dict(asked.dtypes)["a"], dict(whole.dtypes)["b"]
    matrix = lambda column: column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def met(a: pa.Array, q: np.ndarray, b: pa.Array, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, others = a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)
        share = max(1, BATCH_PAIRS // max(1, len(q)))
        for begin in range(0, len(x), share):
            for first in range(0, len(q), BATCH_PAIRS):
                d = between(distance, x[begin : begin + share], q[first : first + BATCH_PAIRS])
                row, query = np.nonzero(others[begin : begin + share, None] != ids[None, first : first + BATCH_PAIRS])
                dist = d[row, query]
                yield pa.RecordBatch.from_arrays([a.take(pa.array(query + first)), b.take(pa.array(row + begin)), pa.array(dist, mask=np.isnan(dist))], ["a", "b", "dist"])

    schema = f"a {kinds[0]}, b {kinds[1]}, dist double"
    if blocks == 1:
        rows = asked.collect()  # within ``most_values`` numbers
        sent = points.sparkSession.sparkContext.broadcast((pa.array([r["a"] for r in rows]), np.array([r["q"] for r in rows], float).reshape(-1, dim)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from met(*sent.value, batch.column(0), matrix(batch.column(1)))

        return whole.repartition(tasks).mapInArrow(run, schema)
    # a task takes a part of the points against a block
    left = whole.select(F.pmod(F.xxhash64("b"), F.lit(tasks)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "b", "x")
    right = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))).alias("part"), F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int").alias("block"), "a", "q")

    def both(some: pa.Table, block: pa.Table) -> pa.Table:
        a, b = block.column("a").combine_chunks(), some.column("b").combine_chunks()
        parts = list(met(a, matrix(block.column("q").combine_chunks()), b, matrix(some.column("x").combine_chunks()))) if len(a) and len(b) else []
        return pa.Table.from_batches(parts) if parts else pa.table([pa.nulls(0, a.type), pa.nulls(0, b.type), pa.nulls(0, pa.float64())], ["a", "b", "dist"])

    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(both, schema)


def merged_best(partials: list[DataFrame], k: int = 2, point_id: str = "vec_id") -> DataFrame:
    """(point_id, rank, cid, dist): the k best of several answers of ``neighbours`` over different centres."""
    every = reduce(DataFrame.unionByName, (p.select(point_id, "cid", "dist") for p in partials))
    best = every.groupBy(point_id).agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "cid"))), 1, k).alias("best"))
    return best.select(point_id, F.posexplode("best").alias("rank", "b")).select(point_id, (F.col("rank") + 1).alias("rank"), "b.cid", "b.dist")


def mapped(assigned: DataFrame, mapping: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    """Replaces the centre by its label in a mapping (node, label), as from a quantiser's node to its cluster; a missing one stays null."""
    return assigned.join(mapping.select(F.col(node).alias("cid"), F.col(label).alias("label")), "cid", "left")


def quantisation_error(points: DataFrame, centres: DataFrame, metrics: list[str], point_id: str = "vec_id", v: str = "v") -> DataFrame:
    """(metric, error): the sum of distances to the nearest centre, a row for each metric."""
    out = None
    for name in metrics:
        row = nearest(points, centres, name, point_id, v).agg(F.sum("dist").alias("error")).select(F.lit(name).alias("metric"), "error")
        out = row if out is None else out.unionByName(row)
    return out


def gram(points: DataFrame, v: str, dim: int) -> DataFrame:
    """(i, j, g): sums of products of components i <= j; partial sums combine before the shuffle."""
    cell = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.transform(F.sequence(i, F.lit(dim - 1)), lambda j: F.struct(i.alias("i"), j.alias("j"), (F.get(v, i) * F.get(v, j)).alias("p"))))))
    return points.select(cell.alias("c")).groupBy("c.i", "c.j").agg(F.sum("c.p").alias("g")).select("i", "j", "g")


def principal_axes(points: DataFrame, v: str, dim: int, centre: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Explained shares, largest first, and axes in columns; vectors aren't centred unless asked for.  Only the dim x dim products reach the driver."""
    if centre:
        mean = vector_stats(points, v, dim).select("mean").withColumnRenamed("mean", "_mean")
        points = points.crossJoin(F.broadcast(mean)).select(F.zip_with(v, "_mean", lambda x, m: x - m).alias(v))
    g = np.zeros((dim, dim))
    for r in gram(points, v, dim).collect():
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["g"]
    values, axes = np.linalg.eigh(g)
    order = np.argsort(-values)
    values = np.maximum(values[order], 0)
    return values / max(values.sum(), 1e-300), axes[:, order]


def project(points: DataFrame, v: str, axes: np.ndarray, n: int, point_id: str = "vec_id") -> DataFrame:
    """(point_id, scores) on the first n axes."""
    return points.select(point_id, F.array(*(dot(F.col(v), F.array(*(F.lit(float(x)) for x in axes[:, i]))) for i in range(n))).alias("scores"))


def similarity_search(points: DataFrame, target, distance: str = "euclidean", point_id: str = "vec_id", v: str = "v") -> DataFrame:
    """(point_id, dist) of every point from the target point; a target that doesn't exist, or has several vectors, is an error."""
    one = points.where(F.col(point_id) == target).select(F.col(v).alias("_target")).distinct()
    if (n := one.limit(2).count()) != 1:
        raise ValueError(f"{target!r} has {'no vector' if n == 0 else 'several vectors'}")
    return points.crossJoin(F.broadcast(one)).select(point_id, metric(distance)(F.col(v), F.col("_target")).alias("dist"))
