"""One query for each operator, over whole tables with production parameters; SQL where it can say the same."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, embedding_dedup, line_dedup, mixing, packing, quality_rules, simhash, suffix_dedup, token_counts, token_files
from .common import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(table(spark, sf_dir, "documents"), end_id=0))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeated(table(spark, sf_dir, "documents"), length=200))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mix(docs, table(spark, sf_dir, "labels")).drop("text")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("whole"))
    words = lambda c: F.filter(F.split(F.translate(c, string.ascii_uppercase, string.ascii_lowercase), "[ \\t\\n\\x0b\\f\\r]+"), lambda x: x != "")
    out = line_dedup.remove_repeated(docs).withColumn("kept", words("text"))
    gone = F.when(F.col("removed").isNull(), 0).otherwise(F.size(words("whole")) - F.size("kept"))
    return out.select("doc_id", gone.cast("long").alias("n_removed"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_spans"), F.md5(F.coalesce(F.array_join("kept", " "), F.lit("")).cast("binary")).alias("kept_md5"))


def op9_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens=1024, end_id=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_simhash, op3_token_files, op4_quality_rules, op5_suffix_dedup, op6_mixing, op7_embedding_dedup, op8_line_dedup, op9_ctw, op10_packing)
}

ORACLE_SQL: dict[str, str] = {
    "op7_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT t.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(t.vec_id, coalesce(m.b, t.vec_id)) AS component_id,
  t.vec_id = least(t.vec_id, coalesce(m.b, t.vec_id)) AS kept
FROM embeddings t LEFT JOIN n ON n.a = t.vec_id LEFT JOIN least m ON m.a = t.vec_id
""",
    # units of 36 words begin at either end of a text and at the least pair of word hashes among 14 neighbouring starts
    "op8_line_dedup": r"""
WITH t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS words
  FROM documents
), t0 AS (
  SELECT doc_id, len(words) - 35 AS m FROM t
), w AS (
  SELECT doc_id, len(words) - 35 AS m, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM t
), h AS (
  SELECT *, left(md5(word), 16) || coalesce(lead(left(md5(word), 16)) OVER (PARTITION BY doc_id ORDER BY i), '') || lpad(CAST(i AS VARCHAR), 12, '0') AS h FROM w
), least AS (
  SELECT DISTINCT doc_id, CAST(right(x, 12) AS BIGINT) AS i FROM (
    SELECT doc_id, m, i, min(h) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 13 FOLLOWING) AS x FROM h WHERE i <= m
  ) WHERE i + 13 <= m
  UNION SELECT doc_id, unnest([1, m]) AS i FROM t0 WHERE m >= 1
), u AS (
  SELECT l.doc_id, l.i, row_number() OVER (PARTITION BY array_to_string(t.words[l.i : l.i + 35], ' ') ORDER BY l.doc_id, l.i) > 1 AS again
  FROM least l JOIN t USING (doc_id)
), g AS (
  SELECT w.doc_id, w.i, w.word, coalesce(max(CASE WHEN u.again THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 35 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM w LEFT JOIN u ON u.doc_id = w.doc_id AND u.i = w.i
), s AS (
  SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS first FROM g
), r AS (
  SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (WHERE first) AS n_spans, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM s GROUP BY doc_id
)
SELECT t.doc_id, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(r.n_spans, 0) AS BIGINT) AS n_spans, md5(coalesce(r.kept, '')) AS kept_md5
FROM t LEFT JOIN r USING (doc_id)
""",
}
