"""Dual-tree Lloyd against all distances."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import dualtree
from tessera.llm.queries import QUERIES

TABLE = "vec_id long, embedding array<double>, label int, cluster string, distance string"


def brute(rows, k=40, rounds=5, dim=64, scale=256):
    """With Python's integers and all pairs; (vec_id, cluster, distance), and the centroids."""
    kept = [(i, [int(v * scale // 1) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and np.isfinite(v) for v in x)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    at = [x for _, x in first]
    found = []
    for turn in range(rounds + 1):
        found = []
        for i, x in kept:
            d, c = min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(at))
            found.append((i, c, d, x))
        if turn < rounds:
            for j in range(len(at)):
                own = [x for _, c, _, x in found if c == j]
                if own:
                    at[j] = [sum(v) // len(own) for v in zip(*own)]
    return [f[:3] for f in found], at


def vectors(n, dim, seed, kind):
    rng = np.random.default_rng(seed)
    if kind == "clusters":
        centres = rng.normal(0, 1, (7, dim))
        x = centres[rng.integers(0, 7, n)] + rng.normal(0, 0.02, (n, dim))
    elif kind == "grid":  # many ties
        x = rng.integers(-1, 2, (n, dim)) / 256
    else:
        x = rng.normal(0, 0.2, (n, dim))
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("kind", ["clusters", "noise", "grid"])
@pytest.mark.parametrize("dim, k", [(2, 5), (64, 12)])
def test_nearest_equals_all_distances(kind, dim, k):
    x = np.unique(np.array([v for _, v in vectors(700, dim, 3, kind)]), axis=0)
    points = dualtree.integers(x, 256)[0]
    points = np.unique(points, axis=0)
    tree = dualtree.Tree.over(points)
    # every node covers its range, and children lie apart
    for node in range(len(tree.lo)):
        own = tree.points[tree.lo[node] : tree.hi[node]].astype(float)
        assert np.sqrt(((own - own[0]) ** 2).sum(1)).max() <= tree.radius[node] + 1e-9
        if tree.children[node]:
            below = range(tree.child[node], tree.child[node] + tree.children[node])
            assert [tree.lo[b] for b in below][1:] + [tree.hi[node]] == [tree.hi[b] for b in below]
    assert sorted(tree.order) == list(range(len(points)))
    rng = np.random.default_rng(5)
    centroids = points[rng.integers(0, len(points), k)].tolist()  # some may be equal
    found = dualtree.Centroids(centroids).of(tree, tree.points)
    got = np.empty(len(points), np.int64)
    for lo, hi, c in zip(found.lo, found.hi, found.centroid):
        got[lo:hi] = c
    want = ((tree.points[:, None] - np.array(centroids)[None]) ** 2).sum(2).argmin(1)
    assert (got == want).all()


def test_bounds_prune_where_vectors_lie_in_clusters():
    points = np.unique(dualtree.integers(np.array([v for _, v in vectors(2000, 64, 1, "clusters")]), 256)[0], axis=0)
    tree = dualtree.Tree.over(points)
    centroids = dualtree.Centroids(points[np.random.default_rng(2).integers(0, len(points), 40)].tolist())
    assert centroids.of(tree, tree.points).compared < 0.75 * len(points) * 40
    few = dualtree.Centroids([p.tolist() for p in points[np.unique(np.round(points[:, 0] / 32), return_index=True)[1]]])
    assert few.of(tree, tree.points).compared < 0.5 * len(points) * len(few.rows)


def odd_rows():
    rows = vectors(300, 64, 7, "noise") + [(1000 + i, v) for i, v in vectors(50, 64, 8, "grid")]
    rng = random.Random(3)
    rows += [rng.choice(rows) for _ in range(80)]  # repeated rows, equal ids
    return rows + [(5, [0.5] * 64), (None, [0.25] * 64), (None, [0.25] * 64), (2001, None), (2002, []), (2003, [0.1] * 63), (2004, [0.1] * 65), (2005, [0.1] * 63 + [None]), (2006, [0.1] * 63 + [float("nan")]), (2007, [0.1] * 63 + [float("inf")])]


@pytest.mark.parametrize("wide", [False, True])
def test_rounds_equal_brute_force(spark, wide):
    rows = odd_rows() + ([(3000, [1e7] * 64), (3001, [-3e5] * 32 + [2.5e5] * 32)] if wide else [])
    table = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], TABLE)
    found, centroids = dualtree.Lloyd(block=64, block_rows=100).cluster(table)
    want, at = brute(rows)
    assert centroids == at
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_distances_beyond_a_long_are_null(spark):
    rows = [(i, [float(i)] * 64) for i in range(45)] + [(50, [1e300] * 64)]
    table = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], TABLE)
    want, _ = brute(rows, k=3)
    found, _ = dualtree.Lloyd(k=3).cluster(table)
    assert sorted(map(tuple, found.collect())) == sorted((i, c, d if d < 1 << 63 else None) for i, c, d in want)


def test_query_on_odd_rows_few_rows_and_none(spark, tmp_path):
    for name, rows in (("odd", odd_rows()), ("few", vectors(9, 64, 1, "noise")), ("none", [])):
        spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], TABLE).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        found = QUERIES["op11_centroid_clusters"](spark, f"{tmp_path}/{name}")
        assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        want, at = brute(rows)
        of = {c: sum(d for _, k, d in want if k == c) for c in range(len(at))}
        marks = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in at]
        assert sorted(map(tuple, found.collect()), key=str) == sorted(((i, c, d, of[c], sum(of.values()), marks[c]) for i, c, d in want), key=str)
