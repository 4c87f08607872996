"""The corpus pipeline: stages in order, each a function (spark, docs, sf_dir) -> DataFrame.

Each stage works on all that its predecessor kept, and learns from that only.
All but the last return the columns of ``docs``.  Rows without id are rows as
others, and take the last place where a group chooses its row.  Rows are told
apart by id and text, so different texts with one id are different documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, jaccard, langid, packing, pulearn
from tessera.llm.queries import WORD_VOCABULARY


def _prepared(spark: SparkSession) -> None:
    """A setting of the pipeline's own session: whole texts travel to Python in batches of 1000 rows, as its stages are written by whoever runs them.

    The operators leave the session alone; with Spark's 10,000 rows the stages' executors take 400 MB more.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: without letters, or below the calibrated score, they go."""
    _prepared(spark)
    held_out = F.coalesce(common.remainder("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs, ~held_out)
    sent = spark.sparkContext.broadcast(model)

    def kept(raws: list[bytes]) -> list[bool]:
        names, scores = sent.value.predict([r.decode() for r in raws])
        return [n != langid.UNKNOWN and s >= sent.value.reject_below for n, s in zip(names, scores.tolist())]

    return common.keep_rows(docs, kept)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more."""
    _prepared(spark)
    held_out = F.coalesce(common.remainder("doc_id", 5) == 0, F.lit(False))
    model = pulearn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return common.keep_rows(docs, lambda raws: (pulearn.scores(model, raws) >= 0.3).tolist())


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    _prepared(spark)
    return jaccard.unique(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    _prepared(spark)
    return packing.pack(docs, WORD_VOCABULARY, 2048)


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("ngram_jaccard_join", join_near_duplicates),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express trained models and tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each stage's result written and read again."""
    store = common.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
