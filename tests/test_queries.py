"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera.plans import catalogue_queries, pipeline_queries, registry, vector_queries  # noqa: F401

DIR = "/root/testdata/sf0.001"
NAMES = ["nn_assign", "dist_pspearson", "partial_stats_merge", "tfidf", "kmeans_lloyd", "dbscan", "hac_cut", "sigma_clip", "patch_accept", "object_catalogue", "level_merge", "sky_match", "group_topk", "manifest_join", "tree_shape", "hac_sweep", "silhouette_squared", "box_distance", "dist_fractional", "background_region", "scan_patches", "good_region", "rank_sample", "image_ordinal", "image_ordinal_early", "cutout_pixels", "segmentation", "field_catalogue", "label_matrix", "in_sorted", "topk_by_cut"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'").fetchall()
    return con


def rows(frame):
    text = lambda v: "" if v is None or v != v else f"{float(v):.4f}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR).toPandas()
    want = duck.execute(registry.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql_or_a_reason():
    without = set(registry.QUERIES) - set(registry.SQL)
    assert without == {"power_spectrum", "pca_variance", "hac_merges", "linkage_merges", "gng_fit", "gng_components", "image_pipeline"}
