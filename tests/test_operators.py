import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog, cluster, features, graph, grid, objects
from tessera.sources import rasters, tables
from tessera.streaming import incremental


def brute_components(nodes, edges):
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(40)]
    nodes = sorted({n for e in edges for n in e} | {999})
    frame = spark.createDataFrame([(n,) for n in nodes], "node long")
    found = dict(graph.components(frame, spark.createDataFrame(edges, "src long, dst long")).collect())
    assert found == brute_components(nodes, edges)


def test_components_of_nothing(spark):
    empty = spark.createDataFrame([], "src long, dst long")
    assert graph.components(spark.range(2).toDF("node"), empty).count() == 2


BLOB = [(0, 0), (1, 0), (1, 1), (3, 3), (9, 9), (9, 8)]


def positions(spark, at=BLOB):
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(at)], "idx long, x int, y int")


def test_neighbours_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    at = [tuple(map(int, p)) for p in rng.integers(-20, 20, (80, 2))]
    for reach in (1, 3):
        found = {tuple(r) for r in objects.neighbours(positions(spark, at), reach).collect()}
        assert found == {(i, j) for i, j in itertools.combinations(range(80), 2) if max(abs(at[i][0] - at[j][0]), abs(at[i][1] - at[j][1])) <= reach}


def test_first_position_belongs_to_its_object(spark):
    found = dict(objects.objects(positions(spark), 1).collect())
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}


def test_levels_keep_fainter_objects_only_beside_brighter_ones(spark):
    bright = spark.createDataFrame([(0, 0), (1, 0), (7, 7)], "idx long, object long")
    faint = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (5, 5), (6, 5)], "idx long, object long")
    found = {tuple(r) for r in objects.merge_levels([bright, faint]).collect()}
    assert found == {(0, 0, 0), (1, 0, 0), (5, 5, 1), (6, 5, 1)}


def test_patch_threshold_leaves_the_image_alone(spark):
    pixels = spark.createDataFrame([(x, y, float(x + y)) for x in range(6) for y in range(6)], "x int, y int, flux double")
    rows = grid.patch_vectors(pixels, spark.createDataFrame([(2, 2), (3, 3)], "gx int, gy int"), 2, ["flux"])
    kept = {r["gx"]: r for r in rows.select("gx", "n", "flux", grid.patch_threshold("flux", 5.0).alias("t")).collect()}
    assert kept[2]["n"] == 16 and sum(kept[2]["t"]) == sum(v for v in kept[2]["flux"] if v >= 5)
    assert kept[3]["flux"] == [float(x + y) for y in range(1, 5) for x in range(1, 5)]


def test_power_spectrum_keeps_energy_and_an_impulse_is_flat():
    patch = np.random.default_rng(4).normal(size=(12, 12))
    assert features.power_spectrum(patch).sum() == pytest.approx(144 * (patch**2).sum())
    impulse = np.zeros((1, 12, 12))
    impulse[0, 6, 6] = 1
    assert features.radial_means(features.power_spectrum(impulse)) == pytest.approx(np.ones((1, 8)))


def test_agglomeration_records_true_distances():
    merges = cluster.agglomerate(np.array([[0.0], [1.0], [10.0], [12.0], [40.0]]))
    assert [m[1:5] for m in merges] == [(0, 1, 1.0, 2), (2, 3, 2.0, 2), (-1, -2, 10.5, 4), (-3, 4, 34.25, 5)]


def test_agglomeration_equals_brute_force():
    x = np.random.default_rng(5).normal(size=(25, 3))
    groups = {i: [i] for i in range(25)}
    want = []
    while len(groups) > 1:
        (a, b), d = min((((a, b), np.linalg.norm(x[groups[a]].mean(0) - x[groups[b]].mean(0))) for a, b in itertools.combinations(groups, 2)), key=lambda p: p[1])
        groups[a] += groups.pop(b)
        want.append(d)
    assert [m[3] for m in cluster.agglomerate(x)] == pytest.approx(want)


def test_too_many_nodes_are_refused(spark):
    with pytest.raises(ValueError):
        cluster.hac(spark.range(5).select(F.col("id").alias("node"), F.array(F.lit(0.0)).alias("v")), "v", most=4)


def test_cuts_refine(spark):
    merges = spark.createDataFrame([(-1, 0, 1, 0.1), (-2, 2, 3, 0.2), (-3, -1, -2, 0.4), (-4, -3, 4, 0.9)], "id long, left long, right long, distance double")
    cut = cluster.roots(merges, spark.createDataFrame([(0.05,), (0.3,), (2.0,)], "threshold double")).collect()
    of = lambda t: {r["node"]: r["root"] for r in cut if r["threshold"] == t}
    assert of(0.05) == {i: i for i in range(5)}
    assert of(0.3) == {0: -1, 1: -1, 2: -2, 3: -2, 4: 4}
    assert set(of(2.0).values()) == {-4}


def test_gas_invariants(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, rng.normal(size=2).tolist()) for i in range(400)], "vec_id long, v array<double>")
    model = cluster.fit_gas(rows, "v", "vec_id", cluster.Gas(max_nodes=12, every=10)).collect()
    nodes = {r["a"] for r in model if r["kind"] == "node"}
    ends = {n for r in model if r["kind"] == "edge" for n in (r["a"], r["b"])}
    assert 2 <= len(nodes) <= 12 and ends == nodes
    assert max(r["age"] for r in model if r["kind"] == "edge") <= 50


def test_ordinals_late_and_early(spark):
    rows = spark.createDataFrame(list(enumerate([1, 2, 3, 1, 2, 1])), "seq int, id int")
    late = [r["ordinal"] for r in catalog.ordinals(rows, "id", ["seq"]).orderBy("seq").collect()]
    early = [r["ordinal"] for r in catalog.ordinals(rows, "id", ["seq"], late=False).orderBy("seq").collect()]
    assert late == [0, 0, 0, 1, 1, 2] and early == [0, 0, 1, 1, 2, 2]


def test_sky_match_equals_all_pairs(spark):
    rng = np.random.default_rng(7)
    place = lambda n: [(i, float(ra), float(dec)) for i, (ra, dec) in enumerate(zip(rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))))]
    a, b = place(60) + [(900, 359.99, 0.0), (901, 10.0, 89.8)], place(400) + [(900, 0.01, 0.0), (901, 190.0, 89.9)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, ra double, dec double")
    found = {r["id"]: r["match_id"] for r in catalog.sky_match(frame(a), frame(b).withColumnRenamed("id", "match_id"), 4.0).collect()}

    def sep(p, q):
        u, v = (np.array([np.cos(np.radians(d)) * np.cos(np.radians(r)), np.cos(np.radians(d)) * np.sin(np.radians(r)), np.sin(np.radians(d))]) for _, r, d in (p, q))
        return np.degrees(2 * np.arcsin(min(1, np.linalg.norm(u - v) / 2)))

    want = {}
    for p in a:
        d, i = min((sep(p, q), q[0]) for q in b)
        if d <= 4:
            want[p[0]] = i
    assert found == want and found[900] == 900 and found[901] == 901


def test_image_and_matrix_files(spark, tmp_path):
    image = np.arange(12.0).reshape(3, 4)
    (tmp_path / "a.fits").write_bytes(rasters.fits_bytes(image))
    (tmp_path / "b.npy").write_bytes(rasters.npy_bytes(image.astype("f4")) + rasters.npy_bytes(np.asfortranarray(image)))
    pixels = {(r["y"], r["x"]): r["value"] for r in rasters.read_pixels(spark, f"{tmp_path}/a.fits").collect()}
    assert pixels == {(y, x): image[y, x] for y in range(3) for x in range(4)}
    rows = [r["v"] for r in rasters.read_vectors(spark, f"{tmp_path}/b.npy").orderBy("idx").collect()]
    assert rows == np.concatenate([image, image]).tolist()
    assert rasters.text_header_matrix(b"rows=2,cols=2".ljust(80) + np.arange(4, dtype="<f4").tobytes()).tolist() == [[0, 1], [2, 3]]


def test_manifests_and_matrices(spark, tmp_path):
    (tmp_path / "areas.csv").write_text("id,field,field_rect,sigma_rect\n1,a,0-10-0-10,None\n")
    (tmp_path / "files.csv").write_text("id,sky_area_id,wavelength,file_name\n5,1,g,x\n4,1,g,y\n6,2,r,z\n7,2,q,w\n")
    rows = {(r["sky_area_id"], r["wavelength"]): r["file_name"] for r in tables.read_manifests(spark, f"{tmp_path}/areas.csv", f"{tmp_path}/files.csv", ["g", "r"]).collect()}
    assert rows == {(1, "g"): "y", (2, "r"): "z"}
    tables.write_matrix(spark.createDataFrame([([1.5, 2.0],)], "v array<double>"), "v", f"{tmp_path}/m", ",")
    assert tables.read_matrix(spark, f"{tmp_path}/m").first()["v"] == [1.5, 2.0]


def test_config_macros_and_options():
    c = tables.Config.read("metric = euclidean # note\nroot=7\npatch=<<root>>\nlog=no\nsigmas=5,2", {"k": "9"})
    assert (c.metric, c.patch, c.log, c.sigmas, c.k) == ("euclidean", 7, False, (5.0, 2.0), 9)


def test_stream_state_survives_new_files(spark, tmp_path):
    schema = "k string, x double"
    for part in range(3):
        spark.createDataFrame([("a", float(part * 10 + i)) for i in range(5)], schema).write.mode("append").parquet(f"{tmp_path}/src")
        incremental.run_stats(spark, f"{tmp_path}/src", schema, "x", ["k"], f"{tmp_path}/state", f"{tmp_path}/ck")
    row = incremental.stats(spark, f"{tmp_path}/state", ["k"]).first()
    x = np.array([p * 10 + i for p in range(3) for i in range(5)], float)
    assert row["n"] == 15 and row["mean"] == pytest.approx(x.mean()) and row["std"] == pytest.approx(x.std(ddof=1))
