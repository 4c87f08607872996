"""The registered queries of this package, with SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, dualtree, fim, jaccard, langid, licences, lm, packing, pulearn, rpforest, rules, tokenfile, toxicity

#: Vocabulary files; they stay where they are installed, on every machine.
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a tree of files: source/thousands/hundreds/tens of the id; any of them can be its directory's notice."""
    n = F.col("doc_id")
    step = lambda k: F.floor(n / k).cast("string")
    path = F.concat_ws("/", F.col("source"), step(1000), step(100), step(10), F.concat(n.cast("string"), F.lit(".txt")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"), F.lit(True).alias("is_file"))
    found = licences.inherit(licences.scan(docs))
    return found.select("doc_id", "licence", F.round("cosine", 6).alias("cosine"), "line", "effective", "from_dir", "up")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = common.Scratch(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, store.path("shards"))
    return tokenfile.digest(spark, store.path("shards"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32 of the id modulo 5 is not 1, the weights on those where it is 2."""
    rest = common.remainder("doc_id", 5)
    found = lm.score(table(spark, sf_dir, "documents"), rest != 1, rest == 2)
    return found.withColumn("held_out", F.coalesce(rest == 1, F.lit(False)))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_VOCABULARY, 2048)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.verdicts(table(spark, sf_dir, "documents"), "v1")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pulearn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.3)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.centroid_clusters(table(spark, sf_dir, "embeddings"), 40, 5)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.7)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    output, form = F.col("output"), F.col("form")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(output).alias("output_sha256"), digest(fim.restored(output, form)).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_license_scan": op2_license_scan,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_token_files": op4_token_files,
    "op5_lm_scores": op5_lm_scores,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_id": op8_language_id,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_toxicity": op12_toxicity,
    "op13_fill_in_middle": op13_fill_in_middle,
}

def _lloyd_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds as common table expressions; a centroid is moved where vectors are nearest to it, else it stays."""
    steps = [f"""k AS MATERIALIZED (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS INTEGER) AS cluster, v FROM k WHERE vec_id IS NOT NULL QUALIFY cluster < {k}
)"""]
    apart = "list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))"
    near = lambda i: f"(SELECT k.vec_id, k.v, min({{'d': CAST({apart} AS BIGINT), 'c': c.cluster}}) AS m FROM (SELECT row_number() OVER () AS r, * FROM k) k, c{i} c GROUP BY k.r, k.vec_id, k.v)"
    for i in range(rounds):
        steps.append(f"""s{i} AS (
  SELECT m.c AS cluster, unnest(range(1, 65)) AS i, unnest(v) AS x FROM {near(i)}
), m{i} AS (
  SELECT cluster, i, sum(x) AS s, count(*) AS n FROM s{i} GROUP BY ALL
), c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(w.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM m{i} GROUP BY cluster) w USING (cluster)
)""")
    return f"""WITH {", ".join(steps)}, a AS (SELECT vec_id, m.c AS cluster, m.d AS distance FROM {near(rounds)})
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a JOIN c{rounds} c USING (cluster)"""


SQL: dict[str, str] = {
    "op11_centroid_clusters": _lloyd_sql(),
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM t WHERE len(words) > 0)
), n AS (
  SELECT t.doc_id, count(g) AS n FROM t LEFT JOIN s USING (doc_id) GROUP BY t.doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
), arcs AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), r AS (
  SELECT doc_id, doc_id AS root FROM n
  UNION
  SELECT y, root FROM r JOIN arcs ON x = doc_id
)
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) USING (doc_id)
""",
    "op7_quality_rules": r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT r, doc_id, text,
    list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), windows AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM cut WHERE len(words) > 7)
), twins AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twins) GROUP BY r
), measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words,
    len(list_filter(words, lambda w: w = upper(w) AND lower(w) <> w AND length(w) > 1)) AS n_upper,
    len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_stutters
  FROM cut LEFT JOIN covered c USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words
    OR (n_dup_lines > 1 AND 100 * n_dup_lines > 30 * n_lines) OR 100 * n_upper > 40 * n_words
    OR 100 * n_stutters > 20 * n_words) AS kept
FROM measured
""",
    "op13_fill_in_middle": r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM t
), c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS i, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS j FROM u
), p AS (
  SELECT doc_id, text, n,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(units[1:i], '') AS prefix, array_to_string(units[i + 1:j], '') AS middle, array_to_string(units[j + 1:n], '') AS suffix
  FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
""",
}
