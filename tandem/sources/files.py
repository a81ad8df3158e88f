"""The stage files: notes, records, mappings, covariates, annotations, dumps and tables, to and from DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators.indicators import source_order

NOTES = "patient_id string, pre_notes array<string>, post_notes array<string>, group string"
EXTRACTIONS = "patient_id string, group string, symptoms array<string>, raw_response string, extraction_time_s double"
NORMALIZED = "patient_id string, group string, symptoms array<string>, symptoms_raw array<string>"
#: Whole cells that say that there is nothing.
NO_SYMPTOMS = ("", "none", "n/a", "na", "no symptoms", "denies")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_notes(spark: SparkSession, path: str, pre: str = "pre", post: str = "post", groups: dict[str, str] | None = None) -> DataFrame:
    """Notes (NOTES) from JSON lines, or from a folder ``<patient>/{pre,post}/*.txt`` with a map of patients to groups."""
    if path.endswith(".jsonl"):
        empty = F.array().cast("array<string>")
        rows = read_jsonl(spark, path, NOTES)
        return rows.select("patient_id", F.coalesce("pre_notes", empty).alias("pre_notes"), F.coalesce("post_notes", empty).alias("post_notes"), "group")
    if os.path.splitext(path)[1]:
        raise ValueError("notes must be a folder or a .jsonl file")
    return read_note_folder(spark, path, pre, post, groups)


def read_note_folder(spark: SparkSession, path: str, pre: str = "pre", post: str = "post", groups: dict[str, str] | None = None) -> DataFrame:
    """Notes in the order of their file names; a patient is a folder with at least one note."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    where = F.regexp_extract("_metadata.file_path", "([^/]+)/([^/]+)/[^/]+$", 0)
    parts = F.split(F.col("at"), "/")
    rows = files.select(F.url_decode(where).alias("at"), "value").select(parts[0].alias("patient_id"), parts[1].alias("side"), parts[2].alias("name"), "value")
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("name", "value")))), lambda x: x["value"])
    out = rows.filter(F.col("side").isin(pre, post)).groupBy("patient_id").agg(side(pre).alias("pre_notes"), side(post).alias("post_notes"))
    group = F.lit(None).cast("string")
    if groups:
        known = spark.createDataFrame(list(groups.items()), "patient_id string, group string")
        return out.join(known, "patient_id", "left")
    return out.withColumn("group", group)


def get_patient(notes: DataFrame, patient_id: str) -> DataFrame:
    return notes.filter(F.col("patient_id") == patient_id).limit(1)


def done_ids(spark: SparkSession, path: str, key: str = "patient_id") -> DataFrame:
    """The distinct keys of an output; none where there is no output yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], f"{key} string")
    return spark.read.schema(f"{key} string").json(path).distinct()


def read_csv(spark: SparkSession, path: str | list[str], infer: bool = False) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=infer, quote='"', escape='"', multiLine=True)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """raw_term, preprocessed_term, normalized_term and tier, blanks as empty strings."""
    return read_csv(spark, path).na.fill("")


def read_covariates(spark: SparkSession, path: str) -> DataFrame:
    """Covariates with inferred types and patient_id as text."""
    rows = read_csv(spark, path, infer=True)
    if "patient_id" not in rows.columns:
        raise ValueError("covariates need a column patient_id")
    return rows.withColumn("patient_id", F.col("patient_id").cast("string"))


def _clean(name: str) -> str:
    return name.lstrip("﻿").strip()


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(annotator, patient_id, terms) of a folder of CSV files, one for each annotator; a patient's last row counts."""
    rows = read_csv(spark, f"{path.rstrip('/')}/*.csv")
    by_name = {_clean(c).lower(): c for c in rows.columns}
    if not {"patient_id", "symptoms"} <= set(by_name):
        raise ValueError("annotations need columns patient_id and symptoms")
    cell = F.trim(F.coalesce(F.col(f"`{by_name['symptoms']}`"), F.lit("")))
    terms = F.filter(F.transform(F.split(cell, ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.select(
        F.regexp_extract("_metadata.file_name", r"^(.*)\.csv$", 1).alias("annotator"), F.trim(f"`{by_name['patient_id']}`").alias("patient_id"),
        F.when(F.lower(cell).isin(*NO_SYMPTOMS), F.array().cast("array<string>")).otherwise(terms).alias("terms"), source_order(rows).alias("at"),
    )
    return rows.filter("patient_id <> ''").groupBy("annotator", "patient_id").agg(F.max_by("terms", "at").alias("terms"))


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """(model, patient_id, symptoms, extraction_time_s) of a folder of JSON lines files, one for each model."""
    rows = read_jsonl(spark, f"{path.rstrip('/')}/*.jsonl", EXTRACTIONS)
    return rows.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.jsonl$", 1).alias("model"), "patient_id", F.coalesce("symptoms", F.array().cast("array<string>")).alias("symptoms"), "extraction_time_s")


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    """(group, pos, term, rate) of a folder of JSON lists, one for each group."""
    rows = spark.read.schema("term string, rate string").option("multiLine", True).json(f"{path.rstrip('/')}/*.json")
    return rows.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("group"), source_order(rows).alias("pos"), "term", "rate")


# Sinks


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite", keep_nulls: bool = True) -> None:
    rows.write.mode(mode).option("ignoreNullFields", not keep_nulls).json(path)


def write_csv(rows: DataFrame, path: str, by: str | None = None, single: bool = True) -> None:
    """A table as CSV with quotes as RFC 4180 has them; by: a folder for each value of a column."""
    out = (rows.coalesce(1) if single else rows).write.mode("overwrite")
    (out.partitionBy(by) if by else out).csv(path, header=True, quote='"', escape='"')
