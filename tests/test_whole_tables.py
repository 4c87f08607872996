"""Queries without SQL reach every row, on rasters and tables beyond any fixed corner."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.plans import catalogue_queries, pipeline_queries, vector_queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tall(tmp_path_factory):
    """Orders of a raster 150 wide and 130 high; whole patches end at y = 127."""
    rng, n, folder = np.random.default_rng(3), 150 * 130, tmp_path_factory.mktemp("tall")
    flux = rng.uniform(1000, 500000, n)
    pq.write_table(pa.table({"o_orderkey": np.arange(n), "o_totalprice": flux, "o_orderpriority": [f"{v % 5}" for v in range(n)]}), f"{folder}/orders.parquet")
    return str(folder)


def test_power_spectrum_scans_the_whole_raster(spark, tall):
    found = {(r["gx"], r["gy"]) for r in catalogue_queries.power_spectrum(spark, tall).select("gx", "gy").collect()}
    assert found == {(x, y) for x in range(4, 146, 8) for y in range(4, 128, 8)}


def test_image_pipeline_sees_rows_beyond_the_first(spark, tall):
    # an object's number is its first patch: y * 1,000,000 + x
    found = [r["object"] // 1_000_000 for r in pipeline_queries.image_pipeline(spark, tall).select("object").collect()]
    assert min(found) < 80 < max(found)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
def test_hac_merges_joins_every_vector(spark):
    ids = {r[0] for r in spark.read.parquet(f"{DIR}/embeddings.parquet").select(F.col("vec_id").cast("long")).collect()}
    merges = vector_queries.hac_merges(spark, DIR).collect()
    assert len(merges) == len(ids) - 1 and max(m["size"] for m in merges) == len(ids)
    assert {k for m in merges for k in (m["left"], m["right"]) if k >= 0} == ids
