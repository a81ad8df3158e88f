"""A corpus pipeline of five operators: rate, dedup exactly, dedup nearly, decontaminate, encode.

Each stage is a function of (spark, docs, sf_dir), where docs is what the stage
before kept (written as Parquet and read again), and returns the documents that
it keeps, with all their columns; the last returns each document's tokens.

Nulls, empty tables and repeated rows: see each operator. Stages keep whole
rows, so repeated rows of one id stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm.decontamination import decontaminate
from tandem.llm.exact_dedup import exact_dedup
from tandem.llm.jaccard_join import jaccard_join
from tandem.llm.quality_classifier import graded
from tandem.llm.queries import quality_model, table
from tandem.llm.sentencepiece_codec import round_trips
from tandem.llm.storage import new_path, stored
from tandem.shipping import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade (neither toxic nor of low quality) is a half or more."""
    ship(spark)
    return graded(docs, quality_model(spark, sf_dir, docs), least=2).filter("keep").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, one."""
    ship(spark)
    gone = stored(exact_dedup(docs).filter("NOT kept").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more), the document with the smallest id."""
    ship(spark)
    gone = stored(jaccard_join(docs, count_links=False).filter("class_id < doc_id").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that they share with a benchmark item."""
    ship(spark)
    cleaned = decontaminate(docs, table(spark, sf_dir, "benchmark"), clean=True)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's SentencePiece encoding: number and digest of its ids, and whether they decode to the text."""
    ship(spark)
    return round_trips(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("benchmark", benchmark), ("tokens", tokens)]

#: SQL can't express the learned classifier, the sampled join or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
