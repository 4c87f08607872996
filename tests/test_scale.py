"""Work that must not grow faster than it has to: blocks of pairs, copies, cells and sums."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.functions import vectors as V
from tessera.operators import assign, catalog, cluster, grid, linkage, weight

ODD = [(50, None), (51, [1.0, 2.0]), (52, [float("nan")] + [1.0] * 7), (53, [0.3] * 8), (54, [1.0, None] + [2.0] * 6), (55, [0.0] * 8)]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [2_000_000, 24])
@pytest.mark.parametrize("name", kernels.NUMPY)
def test_distances_by_blocks_equal_the_expression(spark, name, most):
    x = np.abs(np.random.default_rng(3).normal(size=(40, 8)))
    x[7] = x[5] + 1e-9
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + ODD, "vec_id long, v array<double>")
    queries = frame.where("vec_id % 5 = 0 or vec_id > 49")
    got = assign.distances(frame, queries, name, most_values=most)
    want = {(r["a"], r["b"]): r["dist"] for r in assign.distances(frame, queries, V.metric(name)).collect()}
    found = {(r["a"], r["b"]): r["dist"] for r in got.collect()}
    assert "InArrow" in plan(got) and found.keys() == want.keys()
    for pair, d in want.items():
        assert found[pair] == d or (found[pair] is not None and d is not None and (found[pair] == pytest.approx(d, abs=1e-12) or (d != d and found[pair] != found[pair]))), (pair, d, found[pair])


def test_silhouettes_of_many_copies(spark):
    # 120,000 points at 40 places: all pairs of points would take many minutes
    x = np.random.default_rng(5).normal(size=(40, 2))
    at = spark.range(40).select(F.col("id").alias("p"), F.array(*(F.element_at(F.array(*map(F.lit, x[:, k].tolist())), (F.col("id") + 1).cast("int")) for k in range(2))).alias("v"))
    points = spark.range(120_000).withColumn("p", F.col("id") % 40).withColumn("label", (F.col("id") / 40).cast("long") % 3).join(at, "p")
    began = time.time()
    found = {(r["p"], r["label"]): r["s"] for r in weight.silhouettes(points, "id", "v", "label").select((F.col("id") % 40).alias("p"), "label", "silhouette").groupBy("p", "label").agg(F.min("silhouette").alias("s"), F.max("silhouette").alias("t"), F.count("*").alias("n")).where("s = t and n = 1000").collect()}
    assert len(found) == 120 and time.time() - began < 90
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2)).sum(1)
    for (p, _), s in found.items():
        a, b = d[p] * 1000 / 39_999, d[p] / 40
        assert s == pytest.approx((b - a) / a)


def test_linkage_of_copies_and_rounds_keeps_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(linkage, "all_pairs", None)  # a table of all pairs is made no more
    x = np.random.default_rng(2).normal(size=(14, 3)).repeat([3] + [1] * 13, axis=0)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows + [(20, [0.0] * 3), (21, [0.0] * 3)], "node long, v array<double>")
    sizes = lambda found: [(round(m["distance"], 8), m["size"]) for m in sorted(found, key=lambda m: -m["id"])]
    found = linkage.agglomerated(frame, "v", distance="cosine", linkage="average", block=6).collect()
    want = [(round(abs(m[3]), 8), m[4]) for m in cluster.agglomerate(x, "cosine", linkage="average")]
    assert sizes(found) == want + [(float("inf"), 17), (float("inf"), 18)]
    assert {r["id"] for r in found} == set(range(-17, 0))
    single = linkage.agglomerated(frame.where("node < 16"), "v", linkage="single", block=5).collect()
    assert single[0]["distance"] == 0 and max(r["size"] for r in single) == 16 and len(single) == 15


def test_density_clusters_of_many_copies(spark):
    # 12,000 points at two places near each other: 144,000,000 pairs of points, two of places
    points = spark.range(12_000).select("id", F.array(F.col("id") % 2 * 0.3, F.lit(0.0)).alias("v"))
    points = points.unionByName(spark.createDataFrame([(-5, [9.0, 9.0]), (-6, None), (-7, [float("nan"), 0.0])], "id long, v array<double>"))
    began = time.time()
    found = {(r["cluster"], r["core"]): r["count"] for r in cluster.dbscan(points, "id", "v", 0.45, 5).groupBy("cluster", "core").count().collect()}
    assert found == {(0, True): 12_000, (-1, False): 3} and time.time() - began < 60


@pytest.mark.parametrize("distance", ["pspearson", "cosine", "euclidean", "gradpearson"])
def test_agglomeration_by_centroids_without_a_matrix(spark, monkeypatch, distance):
    x = np.random.default_rng(9).normal(size=(150, 8))
    frame = spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(x)] + [(999, [1.0] * 8), (1000, [2.0] * 8)] * (distance == "cosine"), "node long, v array<double>")
    rows = lambda: [(r["id"], r["left"], r["right"], round(r["distance"], 9), r["size"], np.round(r["centroid"], 9).tolist()) for r in cluster.hac(frame, "v", distance=distance).collect()]
    want = rows()
    monkeypatch.setattr(cluster, "DENSE", 10)
    monkeypatch.setattr(cluster, "agglomerate", None)
    assert rows() == want


def test_agglomeration_of_more_nodes_than_a_matrix_holds(spark):
    # 21,000 were an error
    at = np.random.default_rng(4).normal(size=(21_000, 1)).cumsum(0)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(at)], "node long, v array<double>")
    found = cluster.hac(frame, "v").select("size").collect()
    assert len(found) == 20_999 and max(r["size"] for r in found) == 21_000


def test_agglomeration_without_directions():
    left, right, d, size, _ = cluster.agglomerate_centroids(np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 0.0], [1.0, 0.1]]), "cosine")
    assert (left.tolist(), right.tolist(), size.tolist()) == ([1, 0, -2], [3, -1, 2], [2, 3, 4]) and d[1:].tolist() == [np.inf] * 2


def test_sky_matches_of_many_copies(spark):
    # 20,000 copies at two places against 20,000 at three: 200,000,000 pairs of rows, four of places
    left = spark.range(20_000).select("id", (F.col("id") % 2 * 0.1).alias("ra"), F.lit(10.0).alias("dec"))
    right = spark.range(20_000).select((F.lit(30_000) - F.col("id")).alias("r"), (F.col("id") % 3 * 0.1 - 0.05).alias("ra"), F.lit(10.1).alias("dec"))
    began = time.time()
    found = catalog.sky_match(left, right, 0.45, right_id="r").groupBy((F.col("id") % 2).alias("side"), "r").count().collect()
    # the first place lies between two at equal distance up to rounding: the smaller id wins
    assert {(r["side"], r["r"], r["count"]) for r in found} == {(0, 10_001, 10_000), (1, 10_001, 10_000)} and time.time() - began < 30


@pytest.mark.parametrize("w", [1, 3])
def test_patches_need_few_rows_of_a_grid_point(spark, w):
    at = [(x, y) for x in range(-5, 9) for y in range(-3, 7)] + [(0, 0)]  # one pixel twice
    pixels = spark.createDataFrame([(x, y, float(100 * x + y)) for x, y in at], "x int, y int, flux double")
    points = [(-4, 0), (-1, -1), (0, 0), (1, 2), (5, 5), (40, 0)]
    found = grid.patches(pixels, spark.createDataFrame(points, "gx int, gy int"), w)
    want = [(gx, gy, x - gx, y - gy, float(100 * x + y)) for gx, gy in points for x, y in at if -w <= x - gx < w and -w <= y - gy < w]
    assert sorted(tuple(r) for r in found.select("gx", "gy", "dx", "dy", "flux").collect()) == sorted(want)
    assert found.columns == ["x", "y", "gx", "gy", "dx", "dy", "flux"] and dict(found.dtypes)["dx"] == "int"
    assert "sequence(" not in plan(found)  # there was a row for each of a grid point's (2w)^2 pixels


def _density(x, eps, least, root=True):
    """(cluster, core) by all pairs, in the order of the expression's sums."""
    d = np.zeros((len(x), len(x)))
    for u in x.T:
        d += (u[:, None] - u) ** 2
    near = (np.sqrt(d) if root else d) <= eps
    core = near.sum(1) >= least
    name = np.arange(len(x))
    while True:
        now = np.array([min(name[near[i] & core], default=i) if core[i] else i for i in range(len(x))])
        if (now == name).all():
            break
        name = now
    return [(int(name[i]) if core[i] else int(min(name[near[i] & core], default=-1)), bool(core[i])) for i in range(len(x))]


@pytest.mark.parametrize(("dim", "eps", "least", "distance"), [(1, 0.02, 4, "euclidean"), (2, 0.25, 6, "euclidean"), (2, 0.04, 5, "squared_euclid"), (3, 0.6, 5, "euclidean"), (5, 1.5, 6, "euclidean")])
def test_density_clusters_equal_those_of_all_pairs(spark, dim, eps, least, distance):
    rng = np.random.default_rng(dim)
    x = np.concatenate([rng.normal(size=(150, dim)), rng.normal(scale=0.05, size=(80, dim)) + 1.5, np.repeat(rng.normal(size=(5, dim)), 4, 0)])
    x = np.round(x, 2)  # distances that equal the radius
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    found = {r["id"]: (r["cluster"], r["core"]) for r in cluster.dbscan(frame, "id", "v", eps, least, distance).collect()}
    assert [found[i] for i in range(len(x))] == _density(x, eps, least, distance == "euclidean")


def test_density_makes_no_pairs_of_a_dense_place(spark, monkeypatch):
    # 20,000 different places in a square of one radius have 200 million pairs; two such squares touch in one pair of cores
    x = np.random.default_rng(8).uniform(size=(20_000, 2))
    y = x + [2.5, 0]
    x[0], y[0] = [1.25, 0.5], [2.25, 0.5]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))] + [(50_000, [1e300, 0.0]), (50_001, [1e15, 0.0]), (50_002, [1e15 + 0.5, 0.0])]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    monkeypatch.setattr(cluster, "within", None)
    found = {(r["cluster"], r["core"]): r["count"] for r in cluster.dbscan(frame, "id", "v", 1.0, 5).groupBy("cluster", "core").count().collect()}
    assert found == {(0, True): 40_000, (-1, False): 3}
    found = {(r["cluster"], r["core"]): r["count"] for r in cluster.dbscan(frame, "id", "v", 0.999, 2).groupBy("cluster", "core").count().collect()}
    assert found == {(0, True): 20_000, (20_000, True): 20_000, (50_001, True): 2, (-1, False): 1}


def test_cells_meet_where_their_ends_do_not():
    x = np.array([[float(i), 0.0] for i in range(600)])
    assert cluster._meet(x, x + [0.0, 1.0], 1.0, True) and not cluster._meet(x, x + [0.5, 1.0], 1.0, True)


@pytest.mark.parametrize("distance", ["cosine", "pearson", "pspearson"])
def test_centroid_merges_look_at_rows_in_single_precision(monkeypatch, distance):
    x = np.random.default_rng(6).normal(scale=0.2, size=(500, 16))
    x[7], x[9] = 0.5, 0.0  # without a direction under Pearson's, or any
    products, rows = cluster._Directions.products, []
    monkeypatch.setattr(cluster._Directions, "products", lambda self, r: rows.append(len(r)) or products(self, r))
    got = cluster.agglomerate_centroids(x, distance)
    want = cluster.agglomerate(x, distance)
    assert [tuple(m[1:3]) for m in want] == list(zip(got[0].tolist(), got[1].tolist()))
    assert np.allclose([m[3] for m in want], got[2], atol=1e-12) and np.allclose([m[5] for m in want], got[4])
    assert len(rows) < 1.3 * len(x)  # a product for each merge, and few for those whose nearest has gone


def test_nearest_directions_equal_those_in_double_precision():
    x = np.random.default_rng(4).normal(size=(300, 16))
    x[200:] = x[:100] + 1e-9 * np.random.default_rng(5).normal(size=(100, 16))  # closer than single precision tells
    places = np.arange(300)
    for distance in ("cosine", "pspearson"):
        place, gap = cluster._nearest_directions(x, x, places, distance, 4)
        other, far = cluster._nearest_others(x, x, lambda i, j: places[i, None] == places[j], distance, 4)
        assert np.allclose(gap, far, atol=1e-14) and (place[:100] == other[:100]).all() and (place[100:200] == other[100:200]).all()


@pytest.mark.parametrize("dim", [1, 2])
def test_silhouettes_of_many_places_in_the_plane(spark, monkeypatch, dim):
    rng = np.random.default_rng(dim)
    x = np.concatenate([rng.uniform(size=(3000, dim)), 0.01 * rng.normal(size=(2500, dim)) + 0.3, np.full((1, dim), 40.0)])
    x = np.concatenate([x, x[:50]])  # copies
    label = rng.integers(0, 3, len(x))
    frame = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))] + [(9000, None, 1), (9001, [float("nan")] * dim, 1)], "id long, v array<double>, label int")
    want = {r["id"]: r["silhouette"] for r in weight.silhouettes(frame, "id", "v", "label").collect()}
    monkeypatch.setattr(weight, "PLANE_PLACES", 100)
    monkeypatch.setattr(weight, "_sums_by_blocks", None)
    monkeypatch.setattr(weight.distance_sums, "__defaults__", (100,))
    found = {r["id"]: r["silhouette"] for r in weight.silhouettes(frame, "id", "v", "label").collect()}
    assert found.keys() == want.keys() and max(abs(found[i] - want[i]) for i in want) < 1e-12


def test_average_linkage_looks_again_only_where_something_merged(spark, monkeypatch):
    x = np.random.default_rng(12).normal(size=(260, 8))
    x[200:] = np.round(x[200:])  # equal distances
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, v array<double>")
    plain, looked = linkage._searched, []

    def searched(state, n, block=90):  # several blocks
        looked.append((state.where("fresh").count(), n))
        return plain(state, n, block)

    monkeypatch.setattr(linkage, "_searched", searched)
    blocks = sorted((r["distance"], r["size"]) for r in linkage.agglomerated(frame, "v", distance="cosine", block=15).collect())
    assert len(looked) > 2 and looked[0] == (260, 260) and all(m < n for m, n in looked[1:])
    whole = sorted((r["distance"], r["size"]) for r in linkage.agglomerated(frame, "v", distance="cosine").collect())  # in one task
    assert len(looked) > 2 and np.allclose(blocks, whole, atol=1e-9)
    x = np.random.default_rng(13).normal(size=(200, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, v array<double>")
    want = [(round(m[3], 8), m[4]) for m in cluster.agglomerate(x, "cosine", linkage="average")]
    for block in (15, 1000):
        found = sorted(linkage.agglomerated(frame, "v", distance="cosine", block=block).collect(), key=lambda m: -m["id"])
        assert [(round(m["distance"], 8), m["size"]) for m in found] == want
