"""Trees as tables against plain walks, and linkage against the sequential kernel."""

import random

import numpy as np
import pytest

from tessera.operators import cluster, linkage, trees
from tessera.operators.graph import Tables

SCHEMA = "id long, left long, right long, distance double"


def grown(n, seed, trees_left=1):
    """Random merges of n leaves, not in order of distance, until so many trees are left."""
    rng, live, rows = random.Random(seed), list(range(n)), []
    while len(live) > trees_left:
        a, b = live.pop(rng.randrange(len(live))), live.pop(rng.randrange(len(live)))
        rows.append((-len(rows) - 1, a, b, rng.randrange(1, 64) / 32))
        live.append(rows[-1][0])
    return rows


def walk(rows):
    """node -> (tree, place, parent, level, distance, leaves below) by recursion, and each merge's sum down to its deepest leaf."""
    of = {r[0]: r for r in rows}
    inner = {c for r in rows for c in r[1:3]}
    out, depth = {}, {}

    def visit(node, tree, parent, level, count):
        place = count
        if node not in of:
            out[node] = (tree, place, parent, level, None, [node])
            return count + 1
        _, left, right, d = of[node]
        after = visit(right, tree, node, level + 1, visit(left, tree, node, level + 1, count + 1))
        depth[node] = d + max(depth.get(left, 0.0), depth.get(right, 0.0))
        out[node] = (tree, place, parent, level, d, out[left][5] + out[right][5])
        return after

    for top in of.keys() - inner:
        visit(top, top, None, 0, 0)
    return out, depth


def cut_at(rows, threshold):
    of, inner, out = {r[0]: r for r in rows}, {c for r in rows for c in r[1:3]}, {}

    def visit(node, root):
        if node not in of:
            out[node] = node if root is None else root
            return
        root = node if root is None and of[node][3] < threshold else root
        visit(of[node][1], root)
        visit(of[node][2], root)

    for top in of.keys() - inner:
        visit(top, None)
    return out


@pytest.mark.parametrize("n, left", [(61, 5)])
def test_tables_equal_walks(spark, n, left):
    rows = grown(n, n, left)
    merges = trees.Walks(spark.createDataFrame(rows, SCHEMA))
    want, depth = walk(rows)
    found = trees.preorder(merges).collect()
    assert {r["node"]: (r["tree"], r["place"], r["parent"], r["level"], r["distance"], r["leaves"]) for r in found} == {k: (*w[:5], len(w[5])) for k, w in want.items()} and len(found) == len(want)
    assert sorted(map(tuple, trees.leaves_of(merges).collect())) == sorted((k, leaf) for k, w in want.items() if k < 0 for leaf in w[5])
    shape = {r["id"]: (r["height"], r["depth"]) for r in trees.shape(merges).collect()}
    assert shape == {k: (len(want[k][5]), depth[k]) for k in depth}  # distances are multiples of 1/32, so sums are exact
    levels = [0.0, 0.2, 0.5, 1.0, 1.5, 9.0]
    thresholds = spark.createDataFrame([(t,) for t in levels], "threshold double")
    cut = {t: {} for t in levels}
    for r in trees.cut(merges, thresholds).collect():
        assert r["node"] not in cut[r["threshold"]]
        cut[r["threshold"]][r["node"]] = r["root"]
    assert cut == {t: cut_at(rows, t) for t in levels}
    for r in trees.swept(merges, thresholds).collect():
        sizes = np.unique(list(cut[r["threshold"]].values()), return_counts=True)[1]
        assert (r["n_clusters"], r["largest"], r["mean_size"]) == (len(sizes), sizes.max(), sizes.mean())


def test_a_long_chain(spark):
    n = 20_000  # 100,000 take two minutes here, and give the same
    chain = spark.range(n).selectExpr("-(id + 1) AS id", "CASE WHEN id = 0 THEN 0 ELSE -id END AS left", "id + 1 AS right", "CAST(id + 1 AS double) AS distance")
    toured = trees.tour(chain).where(f"node = {-n} or node = {n} or node = -1 or node = 0").collect()
    assert {r["node"]: (r["tree"], r["leaves"], r["first"], r["place"]) for r in toured} == {-n: (-n, n + 1, 0, 0), n: (-n, 1, n, 2 * n), -1: (-n, 2, 0, n - 1), 0: (-n, 1, 0, n)}


def test_nothing_and_odd_merges(spark):
    none = trees.Walks(spark.createDataFrame([], SCHEMA))
    levels = spark.createDataFrame([(0.5,)], "threshold double")
    for found in (trees.preorder(none), trees.leaves_of(none), trees.shape(none), trees.cut(none, levels), trees.swept(none, levels)):
        assert found.count() == 0
    odd = spark.createDataFrame([(-1, 0, 1, 0.5), (None, 2, 3, 1.0), (-7, None, 3, 1.0)], SCHEMA)
    assert sorted(map(tuple, trees.leaves_of(odd).collect())) == [(-1, 0), (-1, 1)]
    with pytest.raises(ValueError):
        trees.above(spark.createDataFrame([(-1, -2, 0, 1.0), (-2, -1, 1, 1.0)], SCHEMA)).count()


def named(merges):
    """Merges by their leaves: (the two sets, distance, size)."""
    below, out = {}, []
    for i, left, right, d, size in sorted(merges, key=lambda m: -m[0]):
        parts = [below.get(k, frozenset([k])) for k in (left, right)]
        below[i] = parts[0] | parts[1]
        assert min(parts[0]) < min(parts[1]) and len(below[i]) == size
        out.append((parts[0], parts[1], round(d, 8), size))
    return set(out)


@pytest.mark.parametrize("kind, distance", [("average", "cosine"), ("complete", "euclidean")])
def test_reciprocal_rounds_merge_as_the_sequential_kernel(spark, kind, distance):
    x = np.random.default_rng(6).normal(size=(30, 5))
    frame = spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (None, [1.0] * 5), (500, None), (501, [float("nan")] * 5)], "node long, v array<double>")
    found = [tuple(r) for r in linkage.agglomerated(frame, "v", distance=distance, linkage=kind, block=25).collect()]
    want = [(m[0], *(3 * k if k >= 0 else k for k in m[1:3]), m[3], m[4]) for m in cluster.agglomerate(x, distance, linkage=kind)]
    assert named(found) == named(want)
    assert sorted(m[0] for m in found) == list(range(-29, 0))
    assert [round(m[3], 8) for m in sorted(found, reverse=True)] == [round(m[3], 8) for m in want]


def test_linkage_of_many_vectors_is_that_of_the_kernel(spark):
    # 2,000 take more than two minutes here, and give the same
    x = np.random.default_rng(8).normal(size=(400, 8)) + np.repeat(np.arange(20), 20)[:, None]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, v array<double>")
    found = [tuple(r) for r in linkage.agglomerated(frame, "v", linkage="average").collect()]
    assert named(found) == named([m[:5] for m in cluster.agglomerate(x, linkage="average")])


def test_linkage_with_ties_few_nodes_and_no_direction(spark):
    frame = lambda rows: spark.createDataFrame(rows, "node long, v array<double>")
    assert linkage.agglomerated(frame([]), "v").count() == linkage.agglomerated(frame([(1, [0.0])]), "v").count() == 0
    ties = linkage.agglomerated(frame([(i, [float(i)]) for i in range(8)]), "v", linkage="single").collect()
    assert len(ties) == 7 and {r["distance"] for r in ties} == {1.0} and max(r["size"] for r in ties) == 8
    lost = linkage.agglomerated(frame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 0.0])]), "v", distance="cosine").collect()
    assert [(r["id"], r["left"], r["right"]) for r in sorted(lost, reverse=True)] == [(-1, 1, 2), (-2, -1, 3)] and min(lost)["distance"] == float("inf")
    with pytest.raises(ValueError):
        linkage.agglomerated(frame([]), "v", linkage="centroid")


def chain_of(spark, n):
    return spark.range(n).selectExpr("-(id + 1) AS id", "CASE WHEN id = 0 THEN 0 ELSE -id END AS left", "id + 1 AS right", "CAST(id + 1 AS double) AS distance")


def test_steps_of_a_contraction_give_the_walk(spark):
    # random trees, and a chain whose leaves lie on both sides
    rows = grown(90, 7, 3) + [(-1000, 2000, 2001, 0.0)]
    for k in range(1, 61):
        rows.append((-1000 - k, *((1000 + k, 1 - 1000 - k) if k % 3 else (1 - 1000 - k, 1000 + k)), (k % 5) / 32))
    merges = trees.Walks(spark.createDataFrame(rows, SCHEMA), few=2)
    want, depth = walk(rows)
    assert {r["node"]: (r["tree"], r["place"], r["parent"], r["level"], r["distance"], r["leaves"]) for r in trees.preorder(merges).collect()} == {k: (*w[:5], len(w[5])) for k, w in want.items()}
    assert sorted(map(tuple, trees.leaves_of(merges).collect())) == sorted((k, leaf) for k, w in want.items() if k < 0 for leaf in w[5])
    assert {r["id"]: (r["height"], r["depth"]) for r in trees.shape(merges).collect()} == {k: (len(want[k][5]), depth[k]) for k in depth}
    cut = trees.cut(merges, spark.createDataFrame([(0.1,)], "threshold double")).collect()
    assert {r["node"]: r["root"] for r in cut} == cut_at(rows, 0.1)
    with pytest.raises(ValueError):
        trees.walked(spark.createDataFrame([(-1, -2, 0, 1.0), (-2, -3, 1, 1.0), (-3, -1, 2, 1.0)], SCHEMA), few=0)


@pytest.mark.parametrize("kind", ["chain", "heap"])
def test_what_a_walk_writes_grows_as_the_merges(spark, monkeypatch, kind):
    n = 4000
    heap = spark.range(1, n).selectExpr("-id AS id", f"CASE WHEN 2 * id < {n} THEN -2 * id ELSE 2 * id - {n} END AS left", f"CASE WHEN 2 * id + 1 < {n} THEN -2 * id - 1 ELSE 2 * id + 1 - {n} END AS right", "1 / id AS distance")
    written, put = [], Tables.put

    def counted(self, df, name=None):
        out = put(self, df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(Tables, "put", counted)
    merges = chain_of(spark, n) if kind == "chain" else heap
    monkeypatch.setattr(trees, "FEW", 100)
    assert trees.tour(merges).count() == 2 * merges.count() + 1
    assert sum(written) < 8 * n  # 3 n entries in each of 14 rounds before


def test_ranges_over_several_levels_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(trees, "BLOCK", 4)
    rows = grown(150, 3)
    merges = trees.Walks(spark.createDataFrame(rows, SCHEMA))
    want, depth = walk(rows)
    assert {r["id"]: (r["height"], r["depth"]) for r in trees.shape(merges).collect()} == {k: (len(want[k][5]), depth[k]) for k in depth}
    assert sorted(map(tuple, trees.leaves_of(merges).collect())) == sorted((k, leaf) for k, w in want.items() if k < 0 for leaf in w[5])
