"""Rows that hold no numbers, numbers far from zero, and many labels."""

import math
import random
import time

import numpy as np
import pytest

from tessera.functions import kernels
from tessera.operators import assign, cluster, grid, weight
from tessera.sources import rasters

NAN, INF = float("nan"), float("inf")
VECTORS = "id long, v array<double>, label long"


def test_kmeans_ignores_what_is_no_vector(spark):
    good = [(1, [0.0, 0.0]), (2, [10.0, 10.0]), (3, [0.1, 0.0]), (4, [10.1, 10.0])]
    bad = [(0, [NAN, 1.0]), (5, [NAN, 1.0]), (6, [INF, 0.0]), (7, [None, 0.0]), (8, None), (9, [1.0]), (10, [1.0, 2.0, 3.0])]
    points = spark.createDataFrame([(*r, 0) for r in good + bad], VECTORS)
    found = {r["id"]: (r["cid"], round(r["dist"], 9)) for r in cluster.kmeans(points, 2, 5, "id", "v", 2).collect()}
    assert found == {1: (0, 0.0025), 3: (0, 0.0025), 2: (1, 0.0025), 4: (1, 0.0025)}


@pytest.mark.parametrize("distance", ["squared_euclid", "euclidean", "cosine"])
@pytest.mark.parametrize("strategy", ["matrix"])
def test_matrix_form_gives_no_row_to_what_is_no_vector(spark, distance, strategy):
    points = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [NAN, 1.0], 0), (3, [INF, 1.0], 0), (4, None, 0)], VECTORS)
    centres = spark.createDataFrame([(0, [1.0, 2.0]), (1, [NAN, 0.0]), (2, [5.0, -1.0])], "cid long, centre array<double>")
    assert [(r["id"], r["cid"]) for r in assign.nearest(points, centres, distance, "id", "v", strategy).collect()] == [(1, 0)]


@pytest.mark.parametrize("shift", [0.0, 1e6])
@pytest.mark.parametrize("k", [1, 2, 5])
def test_nearest_rows_equal_all_differences(shift, k):
    rng = np.random.default_rng(1)
    at = rng.integers(-3, 4, (40, 3)).astype(float) + shift  # many ties
    x = rng.integers(-3, 4, (300, 3)).astype(float) + shift
    every = ((x[:, None] - at[None]) ** 2).sum(2)
    order = np.argsort(every, axis=1, kind="stable")[:, :k]
    place, d = kernels.nearest_rows(x, at, k)
    assert (place == order).all() and (d == np.take_along_axis(every, order, 1)).all()


def test_order_statistics_end_whatever_the_column_holds(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0]
    frame = spark.createDataFrame([(v,) for v in [*values, NAN, INF, -INF, None]], "x double")
    assert grid.order_statistics(frame, "x", [0, 2, 4], bins=4, few=1) == [1.0, 3.0, 5.0]
    wide = [-1.7e308, 1.7e308, 0.0, 5e-324, 1e-323, -5e-324, 1.0, 1.0 + 2e-16, 7.0]
    frame = spark.createDataFrame([(v,) for v in wide], "x double")
    assert grid.order_statistics(frame, "x", list(range(len(wide))), bins=4, few=1) == sorted(wide)
    equal = spark.createDataFrame([(2.5,)] * 20_000 + [(7.0,)], "x double")
    assert grid.order_statistics(equal, "x", [0, 19_999, 20_000], few=10) == [2.5, 2.5, 7.0]
    with pytest.raises(ValueError):
        grid.order_statistics(frame, "x", [9])


def test_sigma_clip_with_bad_pixels(spark):
    rng = random.Random(1)
    good = [rng.gauss(5, 1) for _ in range(400)] + [60.0]
    rows = [(v,) for v in [*good, NAN, INF, -INF, 0.0, None]]
    found = grid.sigma_clip(spark.createDataFrame(rows, "flux double"), "flux")
    kept = np.array(good)
    for n, mean, median, deviation in found:
        assert (n, round(mean, 9), round(median, 9), round(deviation, 9)) == (len(kept), round(kept.mean(), 9), round(float(np.median(kept)), 9), round(kept.std(), 9))
        kept = kept[np.abs(kept - np.median(kept)) <= 3 * kept.std()]
    assert found[-1][0] <= 400


def silhouette(rows, distance):
    """From all pairs."""
    out = []
    for i, (_, x, own) in enumerate(rows):
        d = {}
        for j, (_, y, label) in enumerate(rows):
            if i != j and x is not None and y is not None:
                value = kernels.to_rows("squared_euclid" if distance == "cosine_half" else distance, np.array(x, float), np.array([y], float))[0]
                if not math.isnan(value):
                    d.setdefault(label, []).append(value)
        a, b = d.get(own), [np.mean(v) for k, v in d.items() if k != own]
        out.append(0.0 if not a or not b or max(np.mean(a), min(b)) == 0 else (min(b) - np.mean(a)) / max(np.mean(a), min(b)))
    return out


@pytest.mark.parametrize("distance", ["euclidean", "squared_euclid", "cosine", "pearson", "pspearson", "gradpearson", "fraceuclidean"])
@pytest.mark.parametrize("block", [7, 1000])
def test_silhouettes_equal_all_pairs(spark, distance, block):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(i % 3, 0.4, 8)).tolist(), i % 3) for i in range(40)] + [(99, rng.normal(5, 1, 8).tolist(), 7)]
    rows += [rows[3], rows[3]]  # repeated rows are points
    found = weight.silhouettes(spark.createDataFrame(rows, VECTORS), "id", "v", "label", distance, block).collect()
    want = silhouette(rows, distance)
    got = sorted((r["id"], r["label"], round(r["silhouette"], 8) + 0.0) for r in found)
    assert got == sorted((i, label, round(float(s), 8) + 0.0) for (i, _, label), s in zip(rows, want))


@pytest.mark.parametrize("shift", [0.0, 1e8])
def test_silhouettes_far_from_zero(spark, shift):
    rows = [(i, [shift + (i % 2) * s + i / 8, s * 0.5], i % 2) for s, i in zip([16.0] * 6, range(6))]
    rows += [(10 + i, [-shift + i / 8, 0.5], 3) for i in range(3)]
    found = weight.silhouettes(spark.createDataFrame(rows, VECTORS), "id", "v", "label", "squared_euclid").collect()
    near = [(i, [x[0] - shift if label < 3 else x[0] + shift - 1e6, x[1]], label) for i, x, label in rows] if shift else rows
    want = dict(zip([r[0] for r in rows], silhouette(near, "squared_euclid")))
    assert all(abs(r["silhouette"] - want[r["id"]]) < 1e-6 for r in found)


def test_silhouettes_of_odd_rows(spark):
    rows = [(1, [0.0, 0.0], 0), (2, [0.5, 0.0], 0), (3, [9.0, 9.0], 1), (4, [9.0, 8.0], 1), (5, [NAN, 1.0], 0), (6, None, 1), (7, [1.0, 1.0], None), (None, [9.0, 9.5], 1)]
    frame = spark.createDataFrame(rows, VECTORS)
    for distance in ("euclidean", "squared_euclid"):
        found = {r["id"]: r["silhouette"] for r in weight.silhouettes(frame, "id", "v", "label", distance).collect()}
        assert len(found) == 8 and found[5] == found[6] == found[7] == 0.0 and all(found[i] > 0.8 for i in (1, 2, 3, 4, None))
        assert weight.silhouettes(frame.limit(0), "id", "v", "label", distance).count() == 0


def test_many_labels_are_counted_in_little_time(spark):
    rows = [(i % 50, (7 * i) % 5000) for i in range(20_000)] + [(3, -1), (3, 5000), (3, None), (77, None), (None, 4)]
    began = time.time()
    hists = weight.histogram(spark.createDataFrame(rows, "key long, label long"), "key", "label", 5000)
    found = {r["key"]: r["counts"] for r in hists.collect()}
    want = {k: np.bincount([lab for key, lab in rows if key == k and lab is not None and 0 <= lab < 5000], minlength=5000).tolist() for k in {r[0] for r in rows}}
    assert found == want
    weights = {r["key"]: r["w"] for r in weight.tf_idf(hists, "key").collect()}
    assert time.time() - began < 30
    counts = np.array([want[k] for k in sorted(want, key=str)], float)
    w = counts * (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1)
    norm = np.linalg.norm(w, axis=1, keepdims=True)
    w = np.where(norm > 0, w / np.where(norm > 0, norm, 1), w)
    assert np.allclose(w, [weights[k] for k in sorted(want, key=str)])


def test_similarity_search_wants_one_target(spark):
    points = spark.createDataFrame([(1, [0.0, 1.0], 0), (2, [3.0, 5.0], 0), (3, [1.0, 1.0], 0), (3, [2.0, 1.0], 0), (1, [0.0, 1.0], 0)], VECTORS)
    assert sorted((r["id"], r["dist"]) for r in assign.similarity_search(points, 2, "euclidean", "id", "v").collect() if r["id"] < 3) == [(1, 5.0), (1, 5.0), (2, 0.0)]
    assert assign.similarity_search(points, 1, "euclidean", "id", "v").count() == 5
    for target in (3, 9):
        with pytest.raises(ValueError):
            assign.similarity_search(points, target, "euclidean", "id", "v")


def test_files_of_equal_names_in_nested_folders(spark, tmp_path):
    listed = []
    for area, folder in ((1, "a"), (2, "b/a")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        path = tmp_path / folder / "x.fits"
        path.write_bytes(rasters.fits_bytes(np.full((3, 4), float(area))))
        listed.append((area, "g", str(path)))
    found = rasters.read_cube(spark, spark.createDataFrame(listed, "area int, band string, path string")).collect()
    assert len(found) == 24 and all(r["g"] == r["area"] for r in found)
