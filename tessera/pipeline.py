"""End to end: from pixels to classified objects, and objects of new pixels by a stored model.

``train`` cuts patches, turns them into spectra, normalises, quantises them with
a growing gas, merges its nodes and picks the cut whose number of clusters is
nearest to the target.  ``detect`` labels the patches of any image with that
model, joins touching patches above each level of brightness to objects, and
describes them.  ``classify`` clusters the objects' weighted histograms.
Each stage is a table, so a run can stop and go on anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as V
from .operators import areas, assign, catalog, cluster, features, grid, objects, weight
from .sources.tables import Config


@dataclass
class Model:
    """What ``detect`` needs: normalisation, labelled nodes, and the metric; and the gas, for a fit that goes on."""

    stats: DataFrame  # one row: mean, std
    nodes: DataFrame  # cid, centre
    mapping: DataFrame  # node, label
    labels: int
    metric: str
    gas: DataFrame | None = None  # as ``cluster.fit_gas`` returns it

    def save(self, folder: str) -> None:
        """Tables of a folder, Parquet each."""
        parts = {"stats": self.stats, "nodes": self.nodes, "mapping": self.mapping, "gas": self.gas}
        for name, rows in parts.items():
            if rows is not None:
                rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        self.stats.sparkSession.createDataFrame([(self.labels, self.metric, self.gas is not None)], "labels long, metric string, gas boolean").write.mode("overwrite").parquet(f"{folder}/meta")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Model:
        read = lambda name: spark.read.parquet(f"{folder}/{name}")
        meta = read("meta").first()
        return cls(read("stats"), read("nodes"), read("mapping"), meta["labels"], meta["metric"], read("gas") if meta["gas"] else None)


def samples(pixels: DataFrame, config: Config, box: tuple[int, int, int, int] | DataFrame, thresholds: dict[str, float] | DataFrame) -> DataFrame:
    """(idx, area, x, y, v): features of accepted patches on the scan grid of a box (bottom, top, left, right).

    Pixels may have an ``area`` (int), the image that they belong to; without it
    there is one, 0.  A box for all is scanned in each area; a table (area, bottom, top, left, right)
    has one for each, and areas that it lacks aren't scanned.  Thresholds are a number for
    each band, or a table (area, bands...) as of ``areas.thresholds``; where one is null, nothing exceeds it.
    """
    w = config.patch
    band_columns = [c for c in thresholds.columns if c != "area"] if isinstance(thresholds, DataFrame) else list(thresholds)
    if "area" not in pixels.columns:
        pixels = pixels.withColumn("area", F.lit(0))
    if isinstance(box, DataFrame):
        points, inside = areas.scan_boxes(box, w, config.stride), areas.crop_to(pixels, box)
    else:
        bottom, top, left, right = box
        points = grid.scan_grid(pixels.sparkSession, bottom + w, top - w + 1, left + w, right - w + 1, config.stride)
        points, inside = points.crossJoin(F.broadcast(pixels.select("area").distinct())), grid.crop(pixels, *box)  # a row for each image
    rows = grid.patch_vectors(inside, points, w, band_columns, ["area"]).where(F.col("n") == 4 * w * w)
    if isinstance(thresholds, DataFrame):
        rows = rows.join(thresholds.select("area", *(F.coalesce(F.col(b).cast("double"), F.lit(float("inf"))).alias(f"_{b}") for b in band_columns)), "area")
        levels = {b: F.col(f"_{b}") for b in band_columns}
    else:
        levels = thresholds
    rows = grid.accepted(rows, w, levels)
    kept = rows.select("area", "gx", "gy", "n", *(grid.patch_threshold(b, t).alias(b) for b, t in levels.items()))
    found = features.patch_features(kept, band_columns, 2 * w, area=["area"])
    v = V.log_floor_train("v") if config.log else F.col("v")
    # area and place on the grid are the key that later stages join on
    idx = F.col("area").cast("long") * 1_000_000_000_000 + F.col("gy").cast("long") * 1_000_000 + F.col("gx")
    return found.select(idx.alias("idx"), "area", F.col("gx").alias("x"), F.col("gy").alias("y"), v.alias("v"))


def normalised(rows: DataFrame, stats: DataFrame, config: Config) -> DataFrame:
    v = V.zscore("v", "mean", "std") if config.zscore else V.mean_centre("v", "mean")
    return rows.crossJoin(F.broadcast(stats)).select("idx", "x", "y", v.alias("v"))


def train(rows: DataFrame, config: Config, gas: cluster.Gas | None = None, start: Model | None = None) -> Model:
    """Fits a model to samples; from a stored model, with its normalisation, the fit goes on.  Without samples there is nothing to fit, an error."""
    first = rows.select("v").first()
    if first is None:
        raise ValueError("no samples: no patch of these pixels is bright and full enough")
    dim = len(first["v"])
    stats = start.stats if start is not None else V.vector_stats(rows, "v", dim).select("mean", "std").checkpoint()
    settings = gas or cluster.Gas(max_nodes=config.max_nodes)
    fitted = cluster.fit_gas(normalised(rows, stats, config), "v", "idx", settings, config.n_samples, iterations=config.iterations or None, start=start.gas if start is not None else None).checkpoint()
    nodes = fitted.where("kind = 'node'").select(F.col("a").cast("long").alias("cid"), F.col("pos").alias("centre"))
    merges = cluster.hac(nodes.withColumnRenamed("cid", "node"), "centre", distance=config.metric, bands=len(config.bands)).checkpoint()
    spark = rows.sparkSession
    top = merges.agg(F.max("distance")).first()[0] or 1.0
    thresholds = spark.range(1, 41).select((F.col("id") * (1.01 * top / 40)).alias("threshold"))
    cut = cluster.labels_of(cluster.roots(merges, thresholds)).checkpoint()
    counts = cut.groupBy("threshold").agg(F.count_distinct("root").alias("n"))
    best = catalog.nearest_target(counts, "n", "threshold", config.target_clusters).first()
    mapping = cut.where(F.col("threshold") == best["threshold"]).select("node", "label").checkpoint()
    return Model(stats, nodes, mapping, best["n"], config.metric, fitted)


def detect(rows: DataFrame, brightness: DataFrame, model: Model, config: Config) -> tuple[DataFrame, DataFrame]:
    """Objects of samples: (idx, area, x, y, label, object, level), and their catalogue.

    brightness: (x, y, sigma), the flux over its deviation, and area if the samples have several.
    """
    metric = V.metric("pspearson", bands=len(config.bands)) if model.metric == "pspearson" else model.metric
    near = assign.nearest(normalised(rows, model.stats, config), model.nodes, metric, "idx")
    labelled = assign.mapped(near, model.mapping).select("idx", "label").join(rows.select("idx", "area", "x", "y"), "idx").join(brightness, [c for c in ("area", "x", "y") if c in brightness.columns]).checkpoint()
    levels = []
    for sigma in config.sigmas:
        bright = labelled.where(F.col("sigma") > sigma)
        levels.append(bright.join(objects.objects(bright, config.stride, same="area"), "idx").checkpoint())
    kept = objects.merge_levels(levels).join(labelled.select("idx", "area", "x", "y", "label"), "idx").checkpoint()
    found = objects.catalogue(kept, config.patch, config.least_patches, keep=["area"])
    return kept, found


def classify(kept: DataFrame, model: Model, config: Config, rounds: int = 10) -> DataFrame:
    """(object, cid, dist, silhouette): clusters of objects by their weighted label histograms."""
    hists = objects.at_least(kept, config.least_patches).where("label is not null")
    weighted = weight.tf_idf(weight.histogram(hists, "object", "label", model.labels), "object").checkpoint()
    found = cluster.kmeans(weighted, config.k, rounds, "object", "w", model.labels)
    scored = weight.silhouettes(found.join(weighted, "object"), "object", "w", "cid")
    return found.join(scored.select("object", "silhouette"), "object")
