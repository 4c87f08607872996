"""Functions beside the registered queries, and odd inputs."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import __main__ as cli
from tessera import pipeline
from tessera.functions import vectors as V
from tessera.operators import assign, catalog, cluster, features, grid, objects, weight
from tessera.operators.graph import ensure_checkpoint_dir
from tessera.sources import rasters, tables
from tessera.streaming import incremental


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def vectors(spark, rows, name="v", key="vec_id"):
    return spark.createDataFrame([(i, v) for i, v in rows], f"{key} long, {name} array<double>")


def test_matrix_form_leaves_odd_vectors_out(spark):
    points = vectors(spark, [(1, [1.0, 2.0]), (2, None), (3, [3.0, 4.0]), (4, [1.0]), (5, [None, 1.0]), (6, [9.0, 9.0])])
    centres = vectors(spark, [(10, [1.0, 2.0]), (11, [9.0, 9.0]), (12, None), (13, [None, 0.0]), (14, [1.0])], "centre", "cid")
    for distance in assign.MATRIX:
        found = {r["vec_id"]: (r["cid"], r["dist"]) for r in assign.nearest(points, centres, distance, strategy="matrix").collect()}
        assert set(found) == {1, 3, 6} and found[1][0] == 10 and found[1][1] == pytest.approx(0) and found[6][0] == 11
    assert assign.matrix_neighbours(points, centres.limit(0)).count() == 0
    named = centres.where("cid < 12").select(F.concat(F.lit("c"), "cid").alias("cid"), "centre")
    assert {r["cid"] for r in assign.nearest(points, named).collect()} == {"c10", "c11"}


def test_merged_statistics_of_large_means(spark):
    rng = np.random.default_rng(0)
    x = 1e9 + rng.integers(0, 3, 300)
    rows = spark.createDataFrame([(None if i % 3 else "a", i % 7, float(v)) for i, v in enumerate(x)], "k string, part int, x double")
    found = {r["k"]: r for r in V.merge_stats(V.partial_stats(rows, "x", ["k", "part"]), ["k"]).collect()}
    for key, own in (("a", x[::3]), (None, np.delete(x, np.arange(0, 300, 3)))):
        assert found[key]["n"] == len(own) and found[key]["mean"] == pytest.approx(own.mean(), rel=1e-15) and found[key]["std"] == pytest.approx(own.std(ddof=1), rel=1e-6)
    whole = V.merge_stats(V.partial_stats(rows, "x", ["part"])).first()
    assert whole["n"] == 300 and whole["std"] == pytest.approx(x.std(ddof=1), rel=1e-6)
    assert V.merge_stats(V.partial_stats(rows.limit(1), "x", ["part"])).first()["std"] is None


def test_small_vector_functions(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, V.row_l2(a).alias("x"))["x"] == pytest.approx([0.6, 0.8])
    assert one(spark, V.move_toward(a, b, 0.5).alias("x"))["x"] == [2.0, 2.0]
    assert one(spark, V.checked_length(a, 2).alias("x"))["x"] == [3.0, 4.0]
    with pytest.raises(Exception, match="vector of length 2"):
        one(spark, V.checked_length(a, 3).alias("x"))
    box = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(5.0))
    assert one(spark, V.rectangle_distance(a, *box).alias("x"))["x"] == 4.0
    V.register("manhattan", lambda p, q: V.total(F.zip_with(p, q, lambda x, y: F.abs(x - y))))
    assert one(spark, V.metric("manhattan")(a, b).alias("x"))["x"] == 6.0
    del V.METRICS["manhattan"]


def test_draws_have_their_means(spark):
    want = {"uniform": 0.5, "normal": 0.0, "exponential": 1.0, "laplace": 0.0, "lognormal": math.exp(0.5), "weibull": math.gamma(1.5), "chi2": 3.0, "student": 0.0, "gamma": 2.5, "inverse_gamma": 1 / 1.5, "beta": 0.6}
    options = {"weibull": {"shape": 2}, "chi2": {"degrees": 3}, "student": {"degrees": 8}, "gamma": {"shape": 2.5}, "inverse_gamma": {"shape": 2.5}, "beta": {"a": 1.5, "b": 1.0}}
    row = spark.range(40_000).select(*(V.draw(k, 7, **options.get(k, {})).alias(k) for k in want), V.draw("cauchy", 7).alias("cauchy")).agg(*(F.avg(k).alias(k) for k in want), F.median("cauchy").alias("cauchy")).first()
    assert {k: row[k] for k in want} == pytest.approx(want, abs=0.06) and abs(row["cauchy"]) < 0.06
    with pytest.raises(ValueError):
        V.draw("zipf", 1)


def test_distances_to_queries_in_blocks(spark):
    x = np.random.default_rng(1).normal(size=(30, 3))
    points = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    for most in (2_000_000, 6):
        found = {(r["a"], r["b"]): r["dist"] for r in assign.distances(points, points.where("vec_id % 10 = 0"), "euclidean", most_values=most).collect()}
        assert found == pytest.approx({(a, b): np.linalg.norm(x[a] - x[b]) for a in (0, 10, 20) for b in range(30) if a != b})


def test_partial_answers_merge(spark):
    x = np.random.default_rng(2).normal(size=(12, 2))
    points, centres = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x[:4])]), vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)], "centre", "cid")
    parts = [assign.neighbours(points, centres.where(f"cid % 3 = {i}"), k=2) for i in range(3)]
    found = {(r["vec_id"], r["rank"]): r["cid"] for r in assign.merged_best(parts).collect()}
    assert found == {(r["vec_id"], r["rank"]): r["cid"] for r in assign.neighbours(points, centres, k=2).collect()}


def test_projection(spark):
    axes = np.array([[0.6, -0.8], [0.8, 0.6]])
    assert assign.project(vectors(spark, [(1, [1.0, 2.0])]), "v", axes, 2).first()["scores"] == pytest.approx([2.2, 0.4])


def test_ranks_and_ordinals_over_ranges(spark):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 4, 200).tolist()
    rows = spark.createDataFrame([(i, int(v)) for i, v in enumerate(ids)], "seq int, id int").repartition(7)
    assert {r["seq"]: r["rank"] for r in catalog.ranked(rows, ["id", "seq"]).collect()} == {seq: n for n, (_, seq) in enumerate(sorted((v, i) for i, v in enumerate(ids)))}
    for late in (True, False):
        want, n = [], 0
        for i in range(200):
            n += (i > 0 and ids[i] < ids[i - 1]) if late else (i < 199 and ids[i] > ids[i + 1])
            want.append(n)
        found = {r["seq"]: r["ordinal"] for r in catalog.ordinals(rows, "id", ["seq"], late=late).collect()}
        assert [found[i] for i in range(200)] == want
    assert catalog.ordinals(rows.limit(0), "id", ["seq"]).count() == catalog.ranked(rows.limit(0), ["seq"]).count() == 0


def test_order_statistics_are_exact(spark):
    x = np.concatenate([np.random.default_rng(4).lognormal(0, 3, 3000), np.full(500, 2.0), [1e12, -5.0]])
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    places = [0, 1, 1500, 2000, 2600, len(x) - 1]
    assert grid.order_statistics(rows, "v", places, bins=16, few=20) == [sorted(x)[k] for k in places]


def test_pixels_and_places(spark):
    ra, dec = catalog.tangent_plane(F.lit(120.0), F.lit(340.0), 189.2, 62.1, 500.0, 400.0, 0.01)
    x, y = catalog.tangent_pixels(F.col("ra"), F.col("dec"), 189.2, 62.1, 500.0, 400.0, 0.01)
    back = spark.range(1).select(ra.alias("ra"), dec.alias("dec")).select("ra", "dec", x.alias("x"), y.alias("y")).first()
    assert (back["x"], back["y"]) == pytest.approx((120, 340)) and abs(back["dec"] - 62.1) < 1 and abs(back["ra"] - 189.2) < 10
    row = one(spark, grid.in_box(F.lit(3), F.lit(4), 4, 9, 0, 3).alias("a"), objects.overlaps(F.lit(0), F.lit(0), F.lit(2), F.lit(1), 2).alias("b"), objects.overlaps(F.lit(0), F.lit(0), F.lit(1), F.lit(1), 2).alias("c"))
    assert tuple(row) == (True, False, True)
    bad = one(spark, grid.rotated_rectangle(F.lit(1.0), F.lit(1.0), 0, 0, 4, 1, 45).alias("a"), grid.rotated_rectangle(F.lit(1.0), F.lit(1.0), 0, 0, 4, 1, 0).alias("b"))
    assert tuple(bad) == (False, True)


def test_catalogues_of_several_fields(spark):
    found = spark.createDataFrame([(0, 1, 10, 20, 5, 8, 9), (1, 1, 11, 20, 4, 8, 9), (2, 7, 0, 0, 1, 1, 1)], "field int, object_id int, centre_x int, centre_y int, n_patches int, width int, height int")
    labels = spark.createDataFrame([(0, 1, 6), (1, 1, 3)], "field int, object_id int, label int")
    fields = spark.createDataFrame([(0, 10.0, 0.0, 10.0, 20.0, 0.1), (1, 359.95, -80.0, 10.0, 20.0, 0.1)], "field int, ra0 double, dec0 double, x0 double, y0 double, scale double")
    rows = {r["field"]: r for r in catalog.field_catalogue(found, labels, fields).collect()}
    assert (rows[0]["label"], rows[0]["ra"], rows[0]["dec"], rows[0]["ra_text"]) == (6, pytest.approx(10.0), pytest.approx(0.0), "00:40:00.00")
    assert rows[1]["label"] == 3 and rows[1]["ra"] < 360 and rows[2]["label"] == -1 and rows[2]["ra"] is None and rows[2]["ra_text"] is None
    scores = spark.createDataFrame([(0, 1, 0.25)], "field int, object_id int, score double")
    texts = {r["field"]: r for r in catalog.final_catalogue(catalog.field_catalogue(found, labels, fields), [scores]).collect()}
    assert texts[0]["ra"] == "10.000000" and texts[0]["score"] == "0.250"


def test_small_catalogue_functions(spark):
    rows = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (2, 3, "c"), (3, 3, "d")], "l int, r int, name string")
    assert {tuple(r) for r in catalog.label_matrix(rows, "l", "r", [2, 3]).collect()} == {(2, 3, 1), (3, 3, 1)}
    assert dict(catalog.in_sorted(rows, spark.createDataFrame([(1,), (9,)], "q int"), "l", "q").collect()) == {1: True, 9: False}
    names = spark.createDataFrame([("dog-12_(raw).csv",), ("cat-3_(log).csv",), ("odd.csv",)], "name string")
    assert [tuple(r)[1:] for r in catalog.sample_files(names, wanted=["dog"]).collect()] == [("dog", "12", "raw")]
    cuts = rows.withColumn("cut", F.lit(5)).withColumn("score", F.col("l") * 1.0)
    assert {r["name"] for r in catalog.top_by_cut(cuts, "cut", "r", "score", "name", 1).collect()} == {"a", "d"}


def test_cut_pixels_and_paint(spark):
    pixels = spark.range(0, 600).select((F.col("id") % 30).cast("int").alias("x"), F.floor(F.col("id") / 30).cast("int").alias("y"), F.col("id").cast("double").alias("flux"))
    found = spark.createDataFrame([(0, 5, 15, 4, 14), (1, 0, 3, 0, 3)], "object_id int, cut_left int, cut_right int, cut_top int, cut_bottom int")
    got = {(r["x"], r["y"]) for r in objects.cut_pixels(pixels, found, 2, 10, 8).collect()}
    assert got == {(x, y) for x in range(3, 17) for y in range(2, 16)}
    places = spark.createDataFrame([(5, 5, 1), (6, 5, 1), (7, 5, 2)], "x int, y int, label int")
    painted = {(r["x"], r["y"]): r["label"] for r in objects.painted(pixels, places, 1).collect()}
    assert painted == {(x, y): 1 if x < 7 else (2 if x == 7 else 2) for x in range(4, 8) for y in (4, 5)} | {(6, y): 1 for y in (4, 5)}


def test_random_patch_follows_the_seed(spark):
    rows = spark.createDataFrame([(i, 0, [float(i - 1)] * 4) for i in range(20)], "gx int, gy int, v array<double>")
    picked = {s: grid.random_patch(rows, "v", 0, s).first()["gx"] for s in range(8)}
    assert len(set(picked.values())) > 2 and min(picked.values()) > 1 and grid.random_patch(rows, "v", 0, 3).first()["gx"] == picked[3]


def test_tree_shape_and_label_rules(spark):
    merges = spark.createDataFrame([(-1, 0, 1, 0.1), (-2, 2, 3, 0.2), (-3, -1, -2, 0.4), (-4, -3, 4, 0.9)], "id long, left long, right long, distance double")
    assert {r["id"]: (r["height"], round(r["depth"], 6)) for r in cluster.tree_shape(merges).collect()} == {-1: (2, 0.1), -2: (2, 0.2), -3: (4, 0.6), -4: (5, 1.5)}
    cut = cluster.roots(merges, spark.createDataFrame([(0.3,)], "threshold double"))
    label = lambda rule, of=None: {r["node"]: r["label"] for r in cluster.labels_of(cut, rule, of).collect()}
    assert label("first_leaf") == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2} and label("root") == {2: 0, 3: 0, 0: 1, 1: 1, 4: 2}
    of = spark.createDataFrame([(0, 7), (2, 7), (4, 9)], "node long, component long")
    assert label("component", of) == {0: 7, 1: 7, 2: 7, 3: 7, 4: 9}
    assert cluster.roots(merges.limit(0), spark.createDataFrame([(0.3,)], "threshold double")).count() == 0
    chain = spark.createDataFrame([(-(i + 1), -i if i else 0, i + 1, float(i + 1)) for i in range(3000)], "id long, left long, right long, distance double")
    assert cluster.roots(chain, spark.createDataFrame([(1500.5,)], "threshold double")).groupBy("root").count().count() == 1501


@pytest.mark.parametrize("linkage", ["average", "complete"])
def test_linkages_equal_brute_force(linkage):
    x = np.random.default_rng(6).normal(size=(18, 2))
    groups, want = {i: [i] for i in range(18)}, []
    apart = lambda a, b: (np.mean if linkage == "average" else np.max)([np.linalg.norm(x[i] - x[j]) for i in groups[a] for j in groups[b]])
    while len(groups) > 1:
        (a, b), d = min((((a, b), apart(a, b)) for a in groups for b in groups if a < b), key=lambda p: p[1])
        groups[a] += groups.pop(b)
        want.append(d)
    assert [m[3] for m in cluster.agglomerate(x, linkage=linkage)] == pytest.approx(want)


def test_gas_goes_on_and_iterates(spark):
    rng = np.random.default_rng(7)
    rows = vectors(spark, [(i, rng.normal(size=2).tolist()) for i in range(120)])
    gas = cluster.Gas(max_nodes=10, every=10)
    first = cluster.fit_gas(rows, "v", "vec_id", gas).cache()
    assert first.where("kind = 'meta'").first()["last"] == 118
    again = cluster.fit_gas(rows, "v", "vec_id", gas, start=first)
    assert again.where("kind = 'meta'").first()["last"] == 238
    # a gas that is stored and taken up again is the gas that went on
    state, order = cluster.GasState(gas, np.zeros((2, 2))), [tuple(r) for r in first.collect()]
    state.restore([(r[1], *r[4:]) for r in order if r[0] == "node"], [r[1:4] for r in order if r[0] == "edge"], 118)
    assert state.step == 118 and [(a, b, g) for a, b, g in state.links()] == sorted(r[1:4] for r in order if r[0] == "edge")
    assert cluster.fit_gas(rows, "v", "vec_id", gas, iterations=400, slices=8).where("kind = 'meta'").first()["last"] == 400
    edges = cluster.edge_coordinates(first).collect()
    assert len(edges) == first.where("kind = 'edge'").count() and all(len(r["at"]) == 4 for r in edges)


def test_within_equals_all_pairs(spark):
    rng = np.random.default_rng(8)
    for dim in (2, 5):
        x = rng.uniform(-2, 2, size=(60, dim))
        found = {tuple(r) for r in cluster.within(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), "vec_id", "v", 1.1).collect()}
        assert found == {(i, j) for i in range(60) for j in range(60) if i != j and np.linalg.norm(x[i] - x[j]) <= 1.1}


@pytest.mark.parametrize("distance", ["squared_euclid", "cosine", "euclidean"])
def test_silhouettes_equal_all_pairs(spark, distance):
    rng = np.random.default_rng(9)
    x, label = rng.normal(size=(25, 3)), [0] * 10 + [1] * 14 + [2]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = {"cosine": 1 - u @ u.T}.get(distance, ((x[:, None] - x) ** 2).sum(2))
    d = np.sqrt(d) if distance == "euclidean" else d
    frame = spark.createDataFrame([(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, label))], "id long, v array<double>, label int")
    found = {r["id"]: r["silhouette"] for r in weight.silhouettes(frame, "id", "v", "label", distance, 7).collect()}
    for i in range(25):
        mean = {k: np.mean([d[i, j] for j in range(25) if j != i and label[j] == k] or [np.nan]) for k in range(3)}
        a, b = mean[label[i]], min(v for k, v in mean.items() if k != label[i])
        assert found[i] == pytest.approx(0 if label[i] == 2 else (b - a) / max(a, b))


def test_images_of_several_areas(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    rng = np.random.default_rng(10)
    listed = []
    for area in (1, 2):
        for band in ("g", "r"):
            path = tmp_path / f"{band}-{area}.fits"
            path.write_bytes(rasters.fits_bytes(rng.uniform(1, 9, (24, 24))))
            listed.append((area, band, str(path)))
    cube = rasters.read_cube(spark, spark.createDataFrame(listed, "area int, band string, path string")).cache()
    assert cube.columns == ["area", "x", "y", "g", "r"] and cube.count() == 2 * 24 * 24 and cube.where("g is null or r is null").count() == 0
    config = tables.Config(patch=2, stride=2, target_clusters=3, least_patches=1, k=2, sigmas=(1.0,), metric="euclidean", bands=("g", "r"), iterations=300)
    rows = pipeline.samples(cube, config, (0, 24, 0, 24), {"g": 2.0, "r": 2.0}).checkpoint()
    assert {r["area"] for r in rows.select("area").distinct().collect()} == {1, 2} and rows.count() == rows.select("idx").distinct().count()
    model = pipeline.train(rows, config, cluster.Gas(max_nodes=12, every=5))
    model.save(f"{tmp_path}/model")
    loaded = pipeline.Model.load(spark, f"{tmp_path}/model")
    bright = cube.select("area", "x", "y", (F.col("g") / 4).alias("sigma"))
    for use in (model, loaded):
        kept, found = pipeline.detect(rows, bright, use, config)
        assert kept.groupBy("object").agg(F.count_distinct("area").alias("n")).where("n > 1").count() == 0
        assert found.columns[0] == "area" and found.count() > 1
    steps = lambda m: m.gas.where("kind = 'meta'").first()["last"]
    assert steps(pipeline.train(rows, config, cluster.Gas(max_nodes=12, every=5), loaded)) == steps(model) + 300
    with pytest.raises(ValueError, match="no samples"):
        pipeline.train(rows.limit(0), config)


def test_text_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m1.csv").write_text('1,"2","3"\n\n4, 5,6\n')
    (tmp_path / "m2.csv").write_text('"7",8,9\n')
    assert sorted(r["v"] for r in tables.read_matrix(spark, f"{tmp_path}/m1.csv").collect()) == [[1, 2, 3], [4, 5, 6]]
    (tmp_path / "q.csv").write_text('"a,b","say ""x""",c\n')
    assert tables.read_matrix(spark, f"{tmp_path}/q.csv", kind="string").first()["v"] == ["a,b", 'say "x"', "c"]
    assert {(r["image"], tuple(r["v"])) for r in tables.read_stacked(spark, f"{tmp_path}/m*.csv", r"m(\d)\.csv").collect()} == {(0, (1, 2, 3)), (0, (4, 5, 6)), (1, (7, 8, 9))}
    (tmp_path / "p.csv").write_text("1,10\n2,20\n1,11\n")
    assert dict(tables.read_pairs(spark, f"{tmp_path}/p.csv").collect()) == {1: 11, 2: 20}
    fields = spark.createDataFrame([("uds_1.fits",), ("egs-2",), ("none",)], "n string").select(tables.field_of(F.col("n"), {"uds": 1, "egs": 2}).alias("f"))
    assert [r["f"] for r in fields.collect()] == [1, 2, None]
    tables.write_dense(spark.createDataFrame([(3, [1, 0, 2])], "k int, counts array<long>"), "k", "counts", f"{tmp_path}/dense")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/dense").collect()] == ["3,1,0,2"]
    tables.write_lines(spark.createDataFrame([("x",), ("y",)], "line string"), f"{tmp_path}/lines", "head")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/lines").collect()) == ["head", "x", "y"]
    areas = spark.createDataFrame([(1, "a"), (2, "b")], "id int, field string")
    files = spark.createDataFrame([(1, 1, "g", "x"), (2, 2, "g", "y")], tables.IMAGE_FILES)
    tables.write_manifests(areas, files, f"{tmp_path}/areas", f"{tmp_path}/files", [2])
    assert spark.read.csv(f"{tmp_path}/files", header=True).count() == spark.read.csv(f"{tmp_path}/areas", header=True).count() == 1


def test_finished_keys(spark, tmp_path):
    items = spark.createDataFrame([(i,) for i in range(4)], "id int")
    incremental.mark_done(items.where("id < 2"), "id", f"{tmp_path}/done")
    incremental.mark_done(items.where("id = 1"), "id", f"{tmp_path}/done")
    assert sorted(r["id"] for r in incremental.pending(items, spark.read.parquet(f"{tmp_path}/done"), "id").collect()) == [2, 3]


def test_event_time_windows(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:10' as ts, 2.0D as x union all select timestamp'2024-01-01 00:00:50', 4.0D union all select timestamp'2024-01-01 01:00:00', 9.0D").write.parquet(f"{tmp_path}/s")
    stream = spark.readStream.schema("ts timestamp, x double").parquet(f"{tmp_path}/s")
    query = incremental.windowed(stream, "ts", "x", "1 minute", "1 minute").writeStream.format("memory").queryName("w").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["n"], r["mean"]) for r in spark.sql("select * from w").collect()] == [(2, 3.0)]


def test_settings_and_command_line(spark, tmp_path):
    c = tables.Config(bands=("g",), log=False, k=4)
    assert tables.Config.read(c.text()) == c
    cli.main(["config", f"{tmp_path}/config", "k=12", "metric=cosine"], spark)
    back = tables.Config.read("\n".join(r[0] for r in spark.read.text(f"{tmp_path}/config").collect()))
    assert (back.k, back.metric, back.patch) == (12, "cosine", 6)
    rows = [(i, [5 + i % 3, 0, 1] if i % 2 else [0, 6 + i % 3, 1]) for i in range(20)]
    spark.createDataFrame(rows, "object long, counts array<long>").write.parquet(f"{tmp_path}/counts")
    for algorithm in ("kmeans", "agg"):
        cli.main(["cluster", "-a", algorithm, "-c", f"{tmp_path}/counts", "-k", "2", "-e", "3", "-x", f"{tmp_path}/{algorithm}"], spark)
        found = spark.read.parquet(f"{tmp_path}/{algorithm}/k=2").collect()
        assert len({(r["object"] % 2, r["cluster"]) for r in found}) == 2 and min(r["silhouette"] for r in found) > 0.8
        assert spark.read.parquet(f"{tmp_path}/{algorithm}").select("k").distinct().count() == 2


def test_features_keep_the_area(spark):
    rows = spark.createDataFrame([(5, 1, 2, 16, [float(v) for v in range(16)])], "area int, gx int, gy int, n int, flux array<double>")
    assert features.patch_features(rows, ["flux"], 4, area=["area"]).first()["area"] == 5
    assert json.loads(features.patch_features(rows, ["flux"], 4).toJSON().first()).keys() == {"gx", "gy", "v"}
