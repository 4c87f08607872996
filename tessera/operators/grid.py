"""Rasters as pixel rows (x, y, one column for each band): scans, patches, masks and background statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_grid(spark: SparkSession, bottom: int, top: int, left: int, right: int, step: int) -> DataFrame:
    """(gx, gy): x from left, y from bottom, both below their upper bounds."""
    axis = lambda low, high, name: spark.range(low, max(low, high), step).select(F.col("id").cast("int").alias(name))
    return axis(left, right, "gx").crossJoin(axis(bottom, top, "gy"))


def crop(pixels: DataFrame, bottom: int, top: int, left: int, right: int, margin: int = 0) -> DataFrame:
    """Pixels of a rectangle without its margin; plain comparisons, which reach the scan."""
    return pixels.where((F.col("x") >= left + margin) & (F.col("x") < right - margin) & (F.col("y") >= bottom + margin) & (F.col("y") < top - margin))


def in_box(x: Column, y: Column, bottom, top, left, right) -> Column:
    """Bounds included."""
    return x.between(left, right) & y.between(bottom, top)


def bands(pixels: DataFrame, wanted: list[str], column: str = "band") -> DataFrame:
    return pixels.where(F.col(column).isin(sorted(wanted)))


def patches(pixels: DataFrame, grid: DataFrame, w: int, area: list[str] | None = None) -> DataFrame:
    """(area..., gx, gy, dx, dy, the pixel's other columns): each pixel with every grid point whose square of side 2w holds it.

    Grid points name the cells of side 2w that their square touches, four at most, and an equi-join
    finds the cells' pixels; there is no comparison of all with all, and no row for each pixel that a grid point asks for.
    With ``area``, grid points and pixels carry the image that they belong to.
    """
    area = area or []
    cell = lambda at: F.floor(at / (2 * w))
    touched = lambda at: F.explode(F.array_distinct(F.array(cell(at - w), cell(at + w - 1))))
    wanted = grid.select(*area, "gx", "gy").withColumn("_cx", touched(F.col("gx"))).withColumn("_cy", touched(F.col("gy")))
    away = lambda at, middle: (F.col(at) - F.col(middle)).cast("int")
    held = wanted.join(pixels.withColumn("_cx", cell(F.col("x"))).withColumn("_cy", cell(F.col("y"))), [*area, "_cx", "_cy"])
    held = held.withColumn("dx", away("x", "gx")).withColumn("dy", away("y", "gy")).where(F.col("dx").between(-w, w - 1) & F.col("dy").between(-w, w - 1))
    return held.select(*area, "x", "y", "gx", "gy", "dx", "dy", *(c for c in pixels.columns if c not in (*area, "x", "y")))


def patch_vectors(pixels: DataFrame, grid: DataFrame, w: int, band_columns: list[str], area: list[str] | None = None) -> DataFrame:
    """(area..., gx, gy, n, one row-major array for each band): at most (2w)^2 values each."""
    area = area or []
    found = patches(pixels, grid, w, area)
    cells = F.array_sort(F.collect_list(F.struct("dy", "dx", *band_columns)))
    rows = found.groupBy(*area, "gx", "gy").agg(cells.alias("c"))
    return rows.select(*area, "gx", "gy", F.size("c").alias("n"), *(F.transform("c", _field(b)).alias(b) for b in band_columns))


def _field(name: str):
    return lambda cell: cell[name].cast("double")


def accepted(patch_rows: DataFrame, w: int, thresholds: dict[str, float], filled: float = 0.8) -> DataFrame:
    """Patches whose centre exceeds the threshold in some band, and whose share of non-zero pixels reaches ``filled`` in all."""
    side = 2 * w
    bright = reduce(lambda a, b: a | b, (F.get(b, F.lit(w * side + w)) > t for b, t in thresholds.items()))
    full = reduce(lambda a, b: a & b, (F.size(F.filter(b, lambda v: v != 0)) >= filled * side * side for b in thresholds))
    return patch_rows.where(bright & full)


def patch_threshold(v: Column | str, t: float) -> Column:
    """Values below the threshold become zero; the patch is a copy, so neighbours keep theirs."""
    return F.transform(v, lambda x: F.when(x < t, 0.0).otherwise(x))


def pixel_threshold(column: Column, t) -> Column:
    return F.when(column < t, 0.0).otherwise(column)


def zero_tests(band_columns: list[str], sigmas: list[float]) -> dict[str, Column]:
    """any_zero: some band is zero; all_dark: none is positive; all_faint: each is below its sigma."""
    both = lambda f, tests: reduce(f, tests)
    return {
        "any_zero": both(lambda a, b: a | b, [F.col(b) == 0 for b in band_columns]),
        "all_dark": both(lambda a, b: a & b, [F.col(b) <= 0 for b in band_columns]),
        "all_faint": both(lambda a, b: a & b, [F.col(b) < s for b, s in zip(band_columns, sigmas, strict=True)]),
    }


def sigma_mask(band_columns: list[str], sigmas: list[Column | float], multiple: float) -> Column:
    """1 where some band exceeds ``multiple`` of its sigma; any number of bands."""
    return reduce(lambda a, b: a | b, (F.col(b) > multiple * F.lit(s) if not isinstance(s, Column) else F.col(b) > multiple * s for b, s in zip(band_columns, sigmas, strict=True))).cast("int")


def sigma_levels(band_columns: list[str], sigmas: list[float], multiples: list[float]) -> list[Column]:
    """A flag for each multiple and band."""
    return [(F.col(b) > m * s).cast("int").alias(f"{b}_{m:g}") for m in multiples for b, s in zip(band_columns, sigmas, strict=True)]


def _finite(column: str) -> Column:
    """Whether a number is there, and neither NaN nor infinite."""
    value = F.col(column).cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def order_statistics(rows: DataFrame, column: str, places: list[int], bins: int = 4096, few: int = 10_000) -> list[float]:
    """The values at places (from 0) of the sorted column, exactly; nulls, NaN and infinities have no place.

    Each pass counts the values between bounds by equal bins, which combine before
    the shuffle, and goes on in the bin that holds the place; only the last few
    values reach the driver, however many there are.
    """
    rows = rows.where(_finite(column)).select(F.col(column).cast("double").alias("v"))
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if places and not 0 <= min(places) <= max(places) < n:
        raise ValueError(f"{n} values have no place {min(places) if min(places) < 0 else max(places)}")
    return [_at_place(rows, place, low, high, bins, few) for place in places]


def _at_place(rows: DataFrame, place: int, low: float, high: float, bins: int, few: int) -> float:
    while low < high:
        inside = rows.where((F.col("v") >= low) & (F.col("v") <= high))
        width = high / 2 - low / 2  # halves, as the difference may overflow
        if width == 0:  # neighbours among the smallest numbers: two values at most
            bin_of = F.when(F.col("v") == low, 0).otherwise(1)
        else:
            bin_of = F.least(F.floor((F.col("v") / 2 - low / 2) / width * bins), F.lit(bins - 1))
        below = 0
        for r in inside.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect():
            if below + r["n"] > place:
                break
            below += r["n"]
        if r["lo"] == r["hi"]:
            return r["lo"]
        if r["n"] <= few:
            return sorted(x[0] for x in rows.where((F.col("v") >= r["lo"]) & (F.col("v") <= r["hi"])).collect())[place - below]
        place, low, high = place - below, r["lo"], r["hi"]
    return low


def sigma_clip(pixels: DataFrame, flux: str, clip: float = 3.0, rounds: int = 50) -> list[tuple[int, float, float, float]]:
    """(n, mean, median, population deviation) of each round; values further than ``clip`` deviations from the median go.

    Zeros are masked, as are nulls, NaN and infinities.  Bounds of a round are literals of the next one's filter,
    so a round is one aggregate over the scan and the passes of an exact median;
    it stops when nothing goes.
    """
    out: list[tuple[int, float, float, float]] = []
    kept = pixels.where((F.col(flux) != 0) & _finite(flux)).select(flux)
    low, high = float("-inf"), float("inf")
    for _ in range(rounds):
        rest = kept.where((F.col(flux) >= low) & (F.col(flux) <= high))
        n, mean, deviation = rest.agg(F.count(flux), F.avg(flux), F.stddev_pop(flux)).first()
        if n == 0 or (out and out[-1][0] == n):
            break
        places = [(n - 1) // 2, n // 2]
        median = sum(order_statistics(rest, flux, sorted(set(places)))) / len(set(places))
        out.append((n, mean, median, deviation))
        low, high = max(low, median - clip * deviation), min(high, median + clip * deviation)
    return out


def background_stats(pixels: DataFrame, flux: str) -> DataFrame:
    """(mean, std, rms): population deviation."""
    return pixels.agg(F.avg(flux).alias("mean"), F.stddev_pop(flux).alias("std"), F.sqrt(F.avg(F.col(flux) * F.col(flux))).alias("rms"))


def background_region(pixels: DataFrame, flux: str, width: int, height: int, least: int = 250, share: float = 0.4, tries: int = 10) -> DataFrame:
    """(k, left, right, bottom, top, filled): the first of ``tries`` central rectangles, each a tenth larger, with more than ``share`` non-zero pixels; else the whole image.

    All candidates are counted in one pass.
    """
    boxes = []
    for k in range(tries):
        half = [max(int(0.2 * side), least) * (1 + 0.1 * k) / 2 for side in (width, height)]
        left, right = max(0, int(width / 2 - half[0])), min(width, int(width / 2 + half[0]))
        bottom, top = max(0, int(height / 2 - half[1])), min(height, int(height / 2 + half[1]))
        boxes.append((k, left, right, bottom, top))
    boxes.append((tries, 0, width, 0, height))
    inside = lambda b: (F.col("x") >= b[1]) & (F.col("x") < b[2]) & (F.col("y") >= b[3]) & (F.col("y") < b[4])
    counted = pixels.agg(*(F.avg(F.when(inside(b), (F.col(flux) != 0).cast("int"))).alias(f"s{b[0]}") for b in boxes))
    one = lambda b: F.struct(*(F.lit(v).alias(n) for v, n in zip(b, ("k", "left", "right", "bottom", "top"))), F.coalesce(f"s{b[0]}", F.lit(0.0)).alias("filled"))
    every = F.array(*map(one, boxes))
    return counted.select(F.get(F.filter(every, lambda r: (r["filled"] > share) | (r["k"] == tries)), F.lit(0)).alias("r")).select("r.*")


def random_patch(patch_rows: DataFrame, v: str, most_dark: int, seed: int = 0) -> DataFrame:
    """One patch with at most ``most_dark`` values that aren't positive, chosen by a hash of its place."""
    fit = patch_rows.where(F.size(F.filter(v, lambda x: x <= 0)) <= most_dark)
    return fit.orderBy(F.xxhash64("gx", "gy", F.lit(seed))).limit(1)


def morphology(mask: DataFrame, erode: bool) -> DataFrame:
    """Erosion or dilation of mask pixels (x, y) by a cross of five pixels; beyond the edge nothing is set."""
    steps = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)))))
    spread = mask.select("x", "y", steps.alias("s")).select((F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    counted = spread.groupBy("x", "y").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") == 5 if erode else F.lit(True)).select("x", "y")


def good_tiles(pixels: DataFrame, tile: list[str], flux: str, ratio: float = 4.0, least_std: float = 0.02) -> DataFrame:
    """(tile..., good, bad, std): tiles with more than ``ratio`` good pixels for each bad one (zero or null), and enough contrast."""
    good = F.sum(F.when(F.coalesce(F.col(flux), F.lit(0.0)) != 0, 1).otherwise(0))
    rows = pixels.groupBy(*tile).agg(good.alias("good"), (F.count("*") - good).alias("bad"), F.stddev_pop(flux).alias("std"))
    return rows.where((F.col("good") > ratio * F.col("bad")) & (F.col("std") > least_std))


def rotated_rectangle(x: Column, y: Column, cx: float, cy: float, width: float, height: float, degrees: float) -> Column:
    """Whether a point lies outside a rotated rectangle: true is a bad pixel."""
    angle = F.radians(F.lit(degrees))
    u = (x - cx) * F.cos(angle) + (y - cy) * F.sin(angle)
    v = (y - cy) * F.cos(angle) - (x - cx) * F.sin(angle)
    return (F.abs(u) > width / 2) | (F.abs(v) > height / 2)
