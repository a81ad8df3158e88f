"""The registered query of each operator, at production parameters, and its oracle SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm.decontamination import decontaminate
from tandem.llm.exact_dedup import exact_dedup
from tandem.llm.jaccard_join import jaccard_join
from tandem.llm.language_id import fit as fit_languages
from tandem.llm.language_id import fold, identify
from tandem.llm.line_dedup import line_dedup
from tandem.llm.ngram_lm import lm_score, train
from tandem.llm.quality_classifier import fit as fit_quality
from tandem.llm.quality_classifier import graded
from tandem.llm.secret_scan import secret_scan
from tandem.llm.sentencepiece_codec import round_trips
from tandem.llm.substring_dedup import substring_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 10) == 0
    scores = lm_score(docs, train(docs.filter(~F.coalesce(held_out, F.lit(False))), order=3))
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame):
    """Grades: 0 toxic, 1 not toxic but of low quality, 2 good; learned from rated documents outside the held-out tenth."""
    rating = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    ratings = table(spark, sf_dir, "labels").select("doc_id", rating.alias("rating"))
    return fit_quality(docs.select("doc_id", "text").filter(fold(F.col("doc_id"), 10) != 0).join(ratings, "doc_id"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = graded(docs, quality_model(spark, sf_dir, docs), least=2)
    return rows.select("doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "expected_grade", "tail", "keep")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = fit_languages(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (op1_line_dedup, op2_ngram_lm, op3_exact_dedup, op4_quality_classifier, op5_language_id, op6_jaccard_join, op7_secret_scan, op8_decontamination, op9_substring_dedup, op10_sentencepiece)}

ORACLE_SQL = {
    "op3_exact_dedup": """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
""",
    "op8_decontamination": """
WITH t AS (
  SELECT doc_id AS id, 'd' AS side, text FROM documents UNION ALL SELECT item_id, 'b', text FROM benchmark
), w AS (
  SELECT side, id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM t
), b AS (
  SELECT DISTINCT id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS x
  FROM (SELECT id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM w WHERE side = 'b' AND len(w) > 0)
), d AS (
  SELECT id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM w, (SELECT DISTINCT n FROM b) WHERE side = 'd' AND len(w) >= n)
), o AS (
  SELECT d.id AS doc_id, d.i, d.n, b.id AS item FROM d JOIN b ON d.n = b.n AND d.x = b.x
), hits AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM o) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item AS VARCHAR) AS s FROM o) GROUP BY doc_id
)
SELECT w.id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits ON w.id = hits.doc_id LEFT JOIN items ON w.id = items.doc_id WHERE side = 'd'
""",
    "op9_substring_dedup": """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50
), h AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p
), m AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS low FROM h
), hit AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM m WHERE low < doc_id
), gone AS (
  SELECT doc_id, list(j) AS js, count(*) AS n FROM hit GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(gone.n, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone.js IS NULL THEN w
              ELSE list_filter(w, lambda x, k: NOT list_contains(gone.js, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
""",
}
