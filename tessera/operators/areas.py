"""Many images at once, each with rectangles and a background of its own.

Rectangles are a table (area, bottom, top, left, right) with a row for each image; they
are joined by area, never looped over.  Background levels of all images and bands
come from the same passes: a pass counts the values between each group's bounds, and
each group goes on with bounds of its own until its clipping or its median stands still.
Between passes the driver holds a few numbers for each image and band.

Nulls, NaN and infinities are no values, and zeros are masked.  A group without
values has no row; a null area belongs to no rectangle.  A rectangle that repeats counts once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import Tables
from .grid import _finite

BOX = ("bottom", "top", "left", "right")


def _boxes(boxes: DataFrame) -> DataFrame:
    return boxes.select("area", *(F.col(c).cast("int").alias(c) for c in BOX)).where("area is not null").dropna().distinct()


def scan_boxes(boxes: DataFrame, w: int, step: int) -> DataFrame:
    """(area, gx, gy): each image's grid points whose squares of side 2w lie in its rectangle, from its left and bottom on."""
    if step < 1:
        raise ValueError("a step of one or more is asked for")
    usable = _boxes(boxes).where((F.col("right") - F.col("left") >= 2 * w) & (F.col("top") - F.col("bottom") >= 2 * w))
    axis = lambda low, high, name: F.explode(F.sequence(F.col(low) + w, F.col(high) - w, F.lit(step))).alias(name)
    return usable.select("area", "bottom", "top", axis("left", "right", "gx")).select("area", "gx", axis("bottom", "top", "gy"))


def crop_to(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels (area, x, y, ...) of their image's rectangle; images without one have none."""
    one = _boxes(boxes).select("area", *(F.col(c).alias(f"_{c}") for c in BOX))
    inside = (F.col("x") >= F.col("_left")) & (F.col("x") < F.col("_right")) & (F.col("y") >= F.col("_bottom")) & (F.col("y") < F.col("_top"))
    return pixels.join(one, "area").where(inside).drop(*(f"_{c}" for c in BOX))


def medians(rows: DataFrame, bounds: dict[str, tuple[int, float, float]], bins: int = 256) -> dict[str, float]:
    """Exact medians by group of rows (g, v), for groups with their number of values and the least and largest of them.

    A pass counts by equal bins between each target's bounds, keeps the bin that holds its place,
    and sends one row for each target.
    """
    spark = rows.sparkSession
    places = {g: sorted({(n - 1) // 2, n // 2}) for g, (n, _, _) in bounds.items() if n}
    open_ = [(g, p, p, *bounds[g][1:]) for g, found in places.items() for p in found]  # group, place, place inside the bounds, bounds
    values: dict[tuple[str, int], float] = {}
    while open_:
        values |= {(g, p): low for g, p, _, low, high in open_ if low == high}
        open_ = [t for t in open_ if t[3] < t[4]]
        if not open_:
            break
        targets = spark.createDataFrame(open_, "g string, place long, inner long, low double, high double")  # two rows for each group
        met = rows.join(F.broadcast(targets), "g").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        width = F.col("high") / 2 - F.col("low") / 2
        in_bin = F.when(width > 0, F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / F.when(width > 0, width) * bins), F.lit(bins - 1))).otherwise(F.when(F.col("v") == F.col("low"), 0).otherwise(1))
        counted = met.groupBy("g", "place", "inner", in_bin.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        running = F.sum("n").over(Window.partitionBy("g", "place").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        chosen = counted.withColumn("upto", running).where((F.col("upto") > F.col("inner")) & (F.col("upto") - F.col("n") <= F.col("inner")))
        open_ = [(r["g"], r["place"], r["inner"] - (r["upto"] - r["n"]), r["lo"], r["hi"]) for r in chosen.collect()]
    return {g: sum(values[g, p] for p in found) / len(found) for g, found in places.items()}


def clipped(rows: DataFrame, groups: list[str], v: str, clip: float = 3.0, rounds: int = 50) -> DataFrame:
    """(groups..., round, n, mean, median, std) of each group's clipping rounds: values further than ``clip`` population deviations from the median go.

    A group stops when nothing of it goes, as ``grid.sigma_clip`` does for one image.
    """
    spark = rows.sparkSession
    names = F.to_json(F.struct(*groups)).alias("g")
    usable = rows.where(_finite(v) & (F.col(v) != 0) & reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in groups)))
    kept = Tables(spark, "clipped").put(usable.select(names, F.col(v).cast("double").alias("v")))
    limits: dict[str, tuple[float, float]] = {}
    before: dict[str, int] = {}
    out = []
    for turn in range(rounds):
        if turn and not limits:
            break
        rest = kept
        if turn:
            table = spark.createDataFrame([(g, *b) for g, b in limits.items()], "g string, low double, high double")  # a row for each group
            rest = kept.join(F.broadcast(table), "g").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).select("g", "v")
        state = {r["g"]: r for r in rest.groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
        moved = {g: r for g, r in state.items() if before.get(g) != r["n"]}
        middle = medians(rest, {g: (r["n"], r["lo"], r["hi"]) for g, r in moved.items()})
        wider = {g: limits.get(g, (float("-inf"), float("inf"))) for g in moved}
        limits = {g: (max(wider[g][0], middle[g] - clip * r["std"]), min(wider[g][1], middle[g] + clip * r["std"])) for g, r in moved.items()}
        before |= {g: r["n"] for g, r in moved.items()}
        out += [(g, turn, r["n"], r["mean"], middle[g], r["std"]) for g, r in moved.items()]
    found = spark.createDataFrame(out, "g string, round int, n long, mean double, median double, std double")
    shape = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in groups)
    return found.select(F.from_json("g", shape).alias("k"), *found.columns[1:]).select("k.*", *found.columns[1:])


def thresholds(pixels: DataFrame, boxes: DataFrame, band_columns: list[str], multiple: float = 5.0, clip: float = 3.0, rounds: int = 50) -> DataFrame:
    """(area, bands...): ``multiple`` times each band's clipped deviation in its image's background rectangle; null without values."""
    inside = crop_to(pixels, boxes)
    bands = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v")) for b in band_columns)))
    levels = clipped(inside.select("area", bands.alias("b")).select("area", "b.band", "b.v"), ["area", "band"], "v", clip, rounds)
    last = levels.groupBy("area", "band").agg((F.max_by("std", "round") * multiple).alias("t"))
    return last.groupBy("area").pivot("band", band_columns).agg(F.first("t"))
