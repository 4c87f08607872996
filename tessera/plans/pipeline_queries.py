"""The whole chain on the raster of ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import pipeline
from ..operators import cluster
from ..operators.graph import ensure_checkpoint_dir
from ..sources.tables import Config
from .catalogue_queries import WIDTH, _pixels, height
from .registry import query


@query()
def image_pipeline(spark, sf_dir):
    """Rows only: the gas is a sequential fit, which SQL has no form for."""
    ensure_checkpoint_dir(spark)
    pixels = _pixels(spark, sf_dir).select("x", "y", F.col("flux").alias("g"), (F.col("flux") * (F.col("x") % 7 + 1)).alias("r"), F.sqrt("flux").alias("i"))
    config = Config(patch=3, stride=3, target_clusters=6, least_patches=2, k=3, sigmas=(1.5, 0.5), metric="euclidean")
    rows = pipeline.samples(pixels, config, (0, height(pixels), 0, WIDTH), {"g": 150000.0, "r": 1e9, "i": 1e9}).checkpoint()
    model = pipeline.train(rows, config, cluster.Gas(max_nodes=40, every=20))
    bright = pixels.select("x", "y", (F.col("g") / 150000 - 1).alias("sigma"))
    kept, _ = pipeline.detect(rows, bright, model, config)
    return pipeline.classify(kept, model, config, 3).select("object", F.col("cid").alias("cluster"), F.round("silhouette", 6).alias("silhouette"))
