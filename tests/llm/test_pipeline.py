"""The pipeline's stages: each keeps what it should of its own input."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import jaccard, langid, pulearn
from tessera.llm.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(120)
    extra = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "", "en", "s", 0), (10_003, "123", "en", "s", 3), (None, docs.first()["text"], "en", "s", 1)], docs.schema)
    before = docs.unionByName(extra).cache()
    kept = before
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, DIR).cache()
        assert after.columns == before.columns
        assert after.exceptAll(kept).count() == 0, name
        if name == "language_id":
            assert after.where("doc_id > 10000").count() == 0
        if name == "ngram_jaccard_join":
            found = jaccard.components(after.where("doc_id is not null"))
            assert found.where("component_id <> doc_id").count() == 0
        kept = after
    assert 60 < kept.count() < before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, DIR)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equal_ids_with_different_texts_stay(spark):
    docs = spark.createDataFrame(
        [
            (1, "a b c d e f g h", "en", "s", 1, "x"), (1, "something else entirely is written down here", "en", "s", 1, "x"), (2, "A b c d e f g h", "en", "s", 1, "x"),
            (2, "A b c d e f g h", "en", "s", 1, "x"), (None, "a b c d e f g H", "en", "s", 1, "x"), (None, "rows without id are documents like others", "en", "s", 1, "x"),
            (None, "Rows without id are documents like others", "en", "s", 1, "x"), (3, "", "en", "s", 1, "x"), (3, "", "en", "s", 1, "x"), (None, None, "en", "s", 1, "x"),
        ],
        "doc_id long, text string, lang string, source string, n_chars long, label string",
    )
    kept = corpus_pipeline.join_near_duplicates(spark, docs, DIR)
    assert kept.columns == docs.columns
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(map(str, found)) == sorted(map(str, [(1, "a b c d e f g h"), (1, "something else entirely is written down here"), (None, next(t for i, t in found if i is None and t)), (3, ""), (3, ""), (None, None)]))


def test_run_on_tables_and_on_empty_ones(spark, tmp_path):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    # the same as the stages one after another, each by the operators' own results on what the one before kept
    want, model = docs, langid.fit(docs, F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))
    names, scores = model.predict([r["text"] or "" for r in want.collect()])
    ids = [r["doc_id"] for r, n, s in zip(want.collect(), names, scores) if n != langid.UNKNOWN and s >= model.reject_below]
    want = want.where(F.col("doc_id").isin(ids)).cache()
    good = pulearn.classify(want, labels).where("predicted = 1").select("doc_id")
    want = want.join(good, "doc_id", "left_semi").cache()
    want = want.join(jaccard.components(want).where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi")
    got = corpus_pipeline.run(spark, DIR)
    assert rows_of(got.select("doc_id").distinct()) == rows_of(want.select("doc_id"))
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "ngram_jaccard_join", "best_fit_packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(SQL) <= set(QUERIES)
    assert langid.UNKNOWN == "und"
