"""Rectangles and backgrounds of many images."""

import numpy as np
import pytest

from tessera import pipeline
from tessera.operators import areas, grid
from tessera.sources import tables

BOXES = "area int, bottom int, top int, left int, right int"
NAN, INF = float("nan"), float("inf")


def cube(spark, sizes, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(a, x, y, float(rng.gamma(2, 3)), float(rng.normal(5, 2))) for a, (h, w) in sizes.items() for y in range(h) for x in range(w)]
    return rows, spark.createDataFrame(rows, "area int, x int, y int, g double, r double")


def test_each_image_is_scanned_in_its_rectangle(spark):
    boxes = spark.createDataFrame([(1, 0, 20, 0, 12), (2, 5, 11, 3, 9), (2, 5, 11, 3, 9), (3, 0, 3, 0, 9), (None, 0, 9, 0, 9), (4, None, 9, 0, 9)], BOXES)
    want = {(1, x, y) for x in range(2, 11, 3) for y in range(2, 19, 3)} | {(2, x, y) for x in range(5, 8, 3) for y in range(7, 10, 3)}
    found = [tuple(r) for r in areas.scan_boxes(boxes, 2, 3).collect()]
    assert set(found) == want and len(found) == len(want)
    rows, pixels = cube(spark, {1: (20, 12), 2: (20, 12), 9: (5, 5)})
    kept = {(r["area"], r["x"], r["y"]) for r in areas.crop_to(pixels, boxes).collect()}
    assert kept == {(a, x, y) for a, x, y, _, _ in rows if a == 1 or (a == 2 and 5 <= y < 11 and 3 <= x < 9)}
    with pytest.raises(ValueError):
        areas.scan_boxes(boxes, 2, 0)


def test_backgrounds_of_all_images_equal_those_of_each(spark):
    rows, pixels = cube(spark, {1: (30, 30), 2: (9, 9), 3: (4, 4)}, 2)
    odd = [(1, 99, 0, v, v) for v in (NAN, INF, -INF, 0.0, None)] + [(5, 0, 0, 0.0, 0.0), (6, 0, 0, 7.5, 1.0), (None, 0, 0, 3.0, 3.0), (3, 50, 0, 500.0, 1.0)]
    every = pixels.unionByName(spark.createDataFrame(odd, pixels.schema))
    found = {}
    for r in areas.clipped(every, ["area"], "g", 2.0, 20).collect():
        found.setdefault(r["area"], []).append((r["round"], r["n"], round(r["mean"], 9), round(r["median"], 9), round(r["std"], 9)))
    assert set(found) == {1, 2, 3, 6}
    for area in (1, 2, 3):
        one = grid.sigma_clip(every.where(f"area = {area}"), "g", 2.0, 20)
        assert sorted(found[area]) == [(i, n, *(round(v, 9) for v in rest)) for i, (n, *rest) in enumerate(one)]
    assert found[6] == [(0, 1, 7.5, 7.5, 0.0)]
    assert areas.clipped(every.limit(0), ["area"], "g").count() == 0


def test_medians_of_equal_tiny_and_huge_values(spark):
    groups = {"a": [2.0] * 500, "b": [1.0, 2.0], "c": [-1.7e308, 1.7e308, 5e-324], "d": [5e-324, 1e-323], "e": list(map(float, range(999)))}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    found = areas.medians(rows, {g: (len(v), min(v), max(v)) for g, v in groups.items()}, bins=4)
    assert found == {g: sum(sorted(v)[i] for i in {(len(v) - 1) // 2, len(v) // 2}) / len({(len(v) - 1) // 2, len(v) // 2}) for g, v in groups.items()}


def test_samples_of_images_with_their_own_rectangles_and_thresholds(spark):
    _, pixels = cube(spark, {1: (24, 24), 2: (24, 24), 3: (24, 24)}, 3)
    config = tables.Config(patch=2, stride=2, metric="euclidean", bands=("g", "r"))
    boxes = spark.createDataFrame([(1, 0, 24, 0, 24), (2, 4, 16, 8, 20)], BOXES)
    levels = areas.thresholds(pixels, boxes, ["g", "r"], 1.5)
    assert sorted(r["area"] for r in levels.collect()) == [1, 2] and levels.columns == ["area", "g", "r"]
    found = pipeline.samples(pixels, config, boxes, levels).checkpoint()
    for area, box in ((1, (0, 24, 0, 24)), (2, (4, 16, 8, 20))):
        own = levels.where(f"area = {area}").first()
        one = pipeline.samples(pixels.where(f"area = {area}"), config, box, {"g": own["g"], "r": own["r"]})
        assert sorted(map(tuple, found.where(f"area = {area}").collect())) == sorted(map(tuple, one.collect())) != []
    assert found.where("area = 3").count() == 0
    nothing = levels.selectExpr("area", "CAST(NULL AS double) AS g", "CAST(NULL AS double) AS r")
    assert pipeline.samples(pixels, config, boxes, nothing).count() == 0
