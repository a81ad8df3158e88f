"""Raw terms to canonical terms: exact and fuzzy vocabulary, ordered rules, a model for the rest; and its application."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions.terms import closest, is_non_symptom, preprocess_term, split_compound, title_case
from tandem.operators.indicators import source_order

#: The canonical term of what is dropped, and the tiers' names.
FILTERED = "[FILTERED]"
TIERS = ("ctcae", "rule", "llm", "filtered")
MAPPING = ("raw_term", "preprocessed_term", "normalized_term", "tier")
#: Fixed value: terms in one call of the model.
BATCH = 40
RULES = Path(__file__).with_name("rules.toml")

Rules = list[tuple[str, str]]


def load_vocabulary(path: str) -> list[str]:
    """Preferred terms from a JSON list of strings or of objects with ``term``; anything else gives none."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    terms = [x.get("term") if isinstance(x, dict) else x for x in data] if isinstance(data, list) else []
    return [t.strip() for t in terms if isinstance(t, str) and t.strip()]


def load_rules(path: str | None = None) -> Rules:
    """(pattern, canonical) in the order of a TOML file of ``[[rule]]`` tables; rules without patterns are skipped."""
    with open(path or RULES, "rb") as f:
        rules = tomllib.load(f).get("rule", [])
    return [("|".join(f"(?:{p})" for p in r["patterns"]), r["canonical"]) for r in rules if r.get("patterns")]


def rule_match(term: Column, rules: Rules) -> Column:
    """The canonical term of the first rule whose pattern is found in the term, or null."""
    if not rules:
        return F.lit(None).cast("string")
    return F.coalesce(*(F.when(term.rlike("(?iU)" + pattern), F.lit(canonical)) for pattern, canonical in rules))


def vocabulary_match(terms: DataFrame, vocabulary: list[str], cutoff: float = 0.9) -> DataFrame:
    """(term, hit) for distinct terms: the entry equal in lower case (the first of them), else the closest, else null."""
    spark = terms.sparkSession
    first: dict[str, str] = {}
    for entry in vocabulary:
        first.setdefault(entry.strip().lower(), entry.strip())
    if not first:
        return terms.select("term", F.lit(None).cast("string").alias("hit"))
    table = spark.createDataFrame(list(first.items()), "key string, entry string")
    exact = terms.join(table, F.lower(F.trim("term")) == F.col("key"), "left").select("term", F.col("entry").alias("hit"))
    # only terms without an equal entry pay for the comparison
    near = exact.filter("hit IS NULL").select("term", closest(F.lower(F.trim("term")), list(first), cutoff).alias("key"))
    near = near.join(table, "key", "left").select("term", F.col("entry").alias("hit"))
    return exact.filter("hit IS NOT NULL").union(near)


def model_groups(terms: DataFrame, answer: Callable[[list[str]], dict[str, str]] | None) -> DataFrame:
    """(term, grouped): a model's canonical term for each distinct term, itself where it gives none or there is no model.

    The model is called with BATCH terms at a time, in order within a partition.
    """
    if answer is None:
        return terms.select("term", F.col("term").alias("grouped"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("term").to_pylist()
            for at in range(0, len(held), BATCH):
                part = held[at : at + BATCH]
                found = answer(part)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([found.get(t) or t for t in part], pa.string())], names=["term", "grouped"])

    return terms.repartitionByRange("term").sortWithinPartitions("term").mapInArrow(run, "term string, grouped string")


def build_mapping(
    raw: DataFrame,
    vocabulary: list[str] | None = None,
    rules: Rules | None = None,
    answer: Callable[[list[str]], dict[str, str]] | None = None,
    exclude: set[str] | None = None,
) -> DataFrame:
    """MAPPING rows for the distinct raw_term of raw: one for each part of a compound term.

    A raw term that is none is filtered whole. Each part is cleaned and goes to
    the vocabulary, the rules, then the model; each of these sees a distinct term once.
    """
    distinct = raw.select("raw_term").filter("raw_term IS NOT NULL").distinct()
    bad = is_non_symptom(F.col("raw_term"))
    parts = F.when(bad, F.array(F.lit(""))).otherwise(F.transform(split_compound(F.col("raw_term")), preprocess_term))
    rows = distinct.select("raw_term", bad.alias("bad"), F.explode(parts).alias("preprocessed_term"))
    term = F.col("preprocessed_term")
    out = F.col("bad") | (term == "") | is_non_symptom(term)
    if exclude:
        out = out | F.lower(term).isin(sorted({e.strip().lower() for e in exclude}))
    rows = rows.withColumn("out", out)
    terms = rows.filter("NOT out").select(term.alias("term")).distinct()
    hits = vocabulary_match(terms, vocabulary or [])
    hits = hits.withColumn("rule", F.when(F.col("hit").isNull(), rule_match(F.col("term"), rules or [])))
    rest = model_groups(hits.filter("hit IS NULL AND rule IS NULL").select("term"), answer)
    known = hits.join(rest, "term", "left").select(
        F.col("term").alias("preprocessed_term"),
        title_case(F.trim(F.coalesce("hit", "rule", "grouped"))).alias("found"),
        F.when(F.col("hit").isNotNull(), "ctcae").when(F.col("rule").isNotNull(), "rule").otherwise("llm").alias("found_tier"),
    )
    rows = rows.join(known, "preprocessed_term", "left")
    pick = lambda a, b: F.when(F.col("out"), F.lit(a)).otherwise(F.col(b))
    return rows.select("raw_term", "preprocessed_term", pick(FILTERED, "found").alias("normalized_term"), pick("filtered", "found_tier").alias("tier"))


def mapping_lookup(mapping: DataFrame) -> DataFrame:
    """(preprocessed_term, normalized_term): of several rows the last."""
    rows = mapping.select(F.trim("preprocessed_term").alias("preprocessed_term"), F.trim("normalized_term").alias("normalized_term"), source_order(mapping).alias("at"))
    return rows.filter("preprocessed_term <> ''").groupBy("preprocessed_term").agg(F.max_by("normalized_term", "at").alias("normalized_term"))


def apply_mapping(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """records with their symptoms replaced by sorted distinct canonical terms, the raw ones in symptoms_raw; no record is lost."""
    rows = records.withColumn("_id", F.monotonically_increasing_id())
    terms = rows.select("_id", F.explode("symptoms").alias("raw")).filter(F.trim("raw") != "")
    terms = terms.select("_id", F.explode(F.transform(split_compound(F.col("raw")), preprocess_term)).alias("preprocessed_term"))
    found = terms.join(mapping_lookup(mapping), "preprocessed_term").filter((F.col("normalized_term") != FILTERED) & (F.col("normalized_term") != ""))
    lists = found.groupBy("_id").agg(F.array_sort(F.collect_set("normalized_term")).alias("found"))
    kept = [c for c in records.columns if c not in ("symptoms", "symptoms_raw")]
    empty = F.array().cast("array<string>")
    return rows.join(lists, "_id", "left").select(*kept, F.coalesce("found", empty).alias("symptoms"), F.col("symptoms").alias("symptoms_raw"))


def ordered_mapping(mapping: DataFrame) -> DataFrame:
    return mapping.select(*MAPPING).orderBy("normalized_term", "raw_term")


def rules_table(spark: SparkSession, rules: Rules) -> DataFrame:
    return spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(rules)], "ord int, pattern string, canonical string")


def first_rule(terms: DataFrame, rules: DataFrame) -> DataFrame:
    """(term, canonical) by a table of rules: the match of smallest ord, for distinct terms."""
    found = terms.join(rules, F.expr("term RLIKE concat('(?iU)', pattern)"))
    return found.groupBy("term").agg(F.min_by("canonical", "ord").alias("canonical"))
