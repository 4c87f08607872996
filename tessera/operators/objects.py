"""Objects: connected groups of labelled patches, their boxes, histograms and catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import ranked
from .graph import components


def neighbours(positions: DataFrame, reach: int, key: str = "idx", same: str | list[str] | None = None) -> DataFrame:
    """(src, dst) with src < dst: positions (key, x, y) at most ``reach`` apart in both axes, and with equal ``same`` if given.

    Cells of the plane are as wide as the reach; a position visits its own cell
    and half of the adjacent ones, so pairs come from an equi-join on cells and once.
    """
    cell = lambda c: F.floor(F.col(c) / (reach + 1)).cast("long")
    extra = [same] if isinstance(same, str) else list(same or [])
    base = positions.select(F.col(key).alias("k"), "x", "y", *extra, cell("x").alias("cx"), cell("y").alias("cy"))
    halves = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1)))))
    left = base.select(F.col("k").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), *extra, "cx", "cy", halves.alias("h"))
    left = left.select("a", "ax", "ay", *extra, (F.col("cx") + F.col("h.i")).alias("cx"), (F.col("cy") + F.col("h.j")).alias("cy"), ((F.col("h.i") == 0) & (F.col("h.j") == 0)).alias("own"))
    met = left.join(base, ["cx", "cy", *extra]).where(~F.col("own") | (F.col("a") < F.col("k")))
    near = met.where((F.abs(F.col("ax") - F.col("x")) <= reach) & (F.abs(F.col("ay") - F.col("y")) <= reach))
    return near.select(F.least("a", "k").alias("src"), F.greatest("a", "k").alias("dst"))


def objects(positions: DataFrame, reach: int, key: str = "idx", same: str | list[str] | None = None) -> DataFrame:
    """(key, object): the smallest key of the component."""
    nodes = positions.select(F.col(key).alias("node"))
    return components(nodes, neighbours(positions, reach, key, same)).select(F.col("node").alias(key), F.col("component").alias("object"))


def at_least(rows: DataFrame, n: int, by: str = "object") -> DataFrame:
    """Rows of objects with n rows or more."""
    return rows.join(rows.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(by), by, "left_semi")


def merge_levels(levels: list[DataFrame], key: str = "idx") -> DataFrame:
    """(key, object, level): objects of the first (brightest) level, then those of further levels that share no position with a kept one.  Objects of one position go."""
    kept = None
    for i, level in enumerate(levels):
        own = at_least(level, 2).select(key, "object", F.lit(i).alias("level"))
        if kept is not None:
            taken = own.join(kept.select(key), key, "left_semi").select("object").distinct()
            own = kept.unionByName(own.join(taken, "object", "left_anti").select(key, "object", "level"))
        kept = own
    return kept


def overlaps(ax: Column, ay: Column, bx: Column, by: Column, side: int) -> Column:
    """Whether two open squares of a side overlap."""
    return (F.abs(ax - bx) < side) & (F.abs(ay - by) < side)


def sizes(rows: DataFrame, label: str) -> DataFrame:
    """(label, n), largest first."""
    return rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def boxes(rows: DataFrame, patch: int, by: str = "object") -> DataFrame:
    """(object, n_patches, left, right, top, bottom, centre_x, centre_y): bounds widened by the patch radius, centres truncated."""
    return rows.groupBy(by).agg(
        F.count("*").alias("n_patches"), (F.min("x") - patch).alias("left"), (F.max("x") + patch).alias("right"), (F.min("y") - patch).alias("top"), (F.max("y") + patch).alias("bottom"),
        F.avg("x").cast("int").alias("centre_x"), F.avg("y").cast("int").alias("centre_y"), F.min(F.struct("x", "y")).alias("first"),
    )


def catalogue(rows: DataFrame, patch: int, least: int = 1, by: str = "object", keep: list[str] | None = None) -> DataFrame:
    """The 14 columns of an object catalogue, after those to ``keep``, which are the same for all rows of an object.

    Objects are numbered by their first position in (x, y) order, before small
    ones are left out; the cut-out is a square around the centre, as wide as the
    longer side, and the bounding square shares the box's upper left corner.
    """
    b = boxes(rows, patch, by)
    keep = keep or []
    if keep:
        b = b.join(rows.groupBy(by).agg(*(F.min(c).alias(c) for c in keep)), by)
    width, height = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    side = F.greatest(width, height)
    half = F.floor(side / 2)
    numbered = ranked(b.withColumn("_x", F.col("first.x")).withColumn("_y", F.col("first.y")), ["_x", "_y", by], "object_id").withColumn("object_id", F.col("object_id").cast("int"))
    return numbered.where(F.col("n_patches") >= least).select(
        *keep, "object_id", "n_patches", width.alias("width"), height.alias("height"),
        *((F.col(c) - half if sign < 0 else F.col(c) + half).cast("int").alias(f"cut_{name}") for name, c, sign in (("left", "centre_x", -1), ("right", "centre_x", 1), ("top", "centre_y", -1), ("bottom", "centre_y", 1))),
        "centre_x", "centre_y", F.col("left").alias("br_left"), (F.col("left") + side).alias("br_right"), F.col("top").alias("br_top"), (F.col("top") + side).alias("br_bottom"),
    )


def eligible(left: str, right: str, top: str, bottom: str, n: str, least_side: int = 5, least_patches: int = 2) -> Column:
    """Whether a cut-out is worth making: inside the image, wide enough in some axis, or with enough patches."""
    inside = (F.col(left) >= 0) & (F.col(right) >= 0) & (F.col(top) >= 0) & (F.col(bottom) >= 0)
    return inside & ((F.col(right) - F.col(left) >= least_side) | (F.col(bottom) - F.col(top) >= least_side) | (F.col(n) >= least_patches))


def cutout(x: Column, y: Column, side: int, width: int, height: int, flip: bool = False) -> list[Column]:
    """(left, right, top, bottom) of a square around a point, clamped to the image; y counts from the other edge if flipped."""
    y = height - y if flip else y
    half = side // 2
    clamp = lambda v, high: F.greatest(F.lit(0), F.least(v, F.lit(high))).cast("int")
    return [clamp(x - half, width).alias("left"), clamp(x + half, width).alias("right"), clamp(y - half, height).alias("top"), clamp(y + half, height).alias("bottom")]


def cut_pixels(pixels: DataFrame, catalogue_rows: DataFrame, margin: int = 10, least: int = 10, cell: int = 256) -> DataFrame:
    """(object_id, x, y, the pixel's other columns): pixels of each object's cut-out and a margin; cut-outs narrower than ``least`` are left out.

    An object visits the cells that its cut-out touches, so pixels come from an equi-join.
    """
    wide = catalogue_rows.where((F.col("cut_right") - F.col("cut_left") >= least) & (F.col("cut_bottom") - F.col("cut_top") >= least))
    box = wide.select("object_id", *((F.col(f"cut_{s}") + sign * margin).alias(f"_{s}") for s, sign in (("left", -1), ("right", 1), ("top", -1), ("bottom", 1))))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) - 1) / cell)))
    box = box.withColumn("_cx", span("_left", "_right")).withColumn("_cy", span("_top", "_bottom"))
    put = pixels.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    met = put.join(box, ["_cx", "_cy"]).where((F.col("x") >= F.col("_left")) & (F.col("x") < F.col("_right")) & (F.col("y") >= F.col("_top")) & (F.col("y") < F.col("_bottom")))
    return met.select("object_id", *pixels.columns)


def painted(pixels: DataFrame, positions: DataFrame, half: int, label: str = "label") -> DataFrame:
    """(x, y, label): each pixel under a labelled patch of half a side; where patches overlap, the label with more patches wins, then the smaller one."""
    n = positions.groupBy(label).agg(F.count("*").alias("_n"))
    span = F.sequence(F.lit(-half), F.lit(half - 1))
    under = positions.join(n, label).withColumn("_dx", F.explode(span)).withColumn("_dy", F.explode(span))
    spot = under.groupBy((F.col("x") + F.col("_dx")).alias("x"), (F.col("y") + F.col("_dy")).alias("y")).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(label).alias("label"))).alias("m"))
    return pixels.select("x", "y").join(spot, ["x", "y"]).select("x", "y", F.col("m.label").alias(label))


def regions(catalogue_rows: DataFrame, colour: str = "cyan", radius: int = 25) -> DataFrame:
    """(line): region-file circles around object centres."""
    return catalogue_rows.select(F.format_string(f"circle(%d, %d, {radius}) # text={{%d}} color={colour}", "centre_x", "centre_y", "object_id").alias("line"))
