"""Signals by stratum of the patients, and whether the strata differ.

The arms are not paired here: each has its own patients, duplicates united, and
a null group counts as the empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions.special import chi2_pvalue
from tandem.operators.indicators import PAIR, arm

KEYS = ("group", "symptom", "stratum_type", "stratum_value")


def strata_of(covariates: DataFrame, columns: list[str]) -> DataFrame:
    """(patient_id, stratum_type, stratum_value) of some columns (in any case); blank values belong to no stratum."""
    by_lower = {c.lower(): c for c in covariates.columns}
    missing = [c for c in ("patient_id", *columns) if c.lower() not in by_lower]
    if missing or not columns:
        raise ValueError(f"no such covariate columns: {', '.join(missing)}" if missing else "strata must name a column")
    rows = covariates.select(F.trim(F.col(by_lower["patient_id"]).cast("string")).alias("patient_id"), *(F.trim(F.col(by_lower[c.lower()]).cast("string")).alias(c) for c in columns))
    return rows.unpivot("patient_id", columns, "stratum_type", "stratum_value").filter("stratum_value <> ''").distinct()


def _arm(records: DataFrame, strata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patients of each stratum, and how many of them have each symptom."""
    rows = records.withColumn("group", F.coalesce("group", F.lit(""))).withColumn("patient_id", F.col("patient_id").cast("string"))
    roster, long = arm(rows, "union")
    members = roster.join(strata, "patient_id").groupBy("group", "stratum_type", "stratum_value").agg(F.count(F.lit(1)).alias("n"))
    events = long.join(strata, "patient_id").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("events"))
    return members, events


def strata_counts(signal: DataFrame, noise: DataFrame, strata: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """KEYS, n_patients, events and the noise arm's noise_n, noise_events, for all pairs (by default the signal arm's)."""
    members, events = _arm(signal, strata)
    other, other_events = _arm(noise, strata)
    if pairs is None:
        pairs = signal.select(F.coalesce("group", F.lit("")).alias("group"), F.explode("symptoms").alias("symptom")).filter("symptom IS NOT NULL")
    rows = pairs.select("group", "symptom").distinct().join(members, "group")
    rows = rows.join(events, list(KEYS), "left").join(other.withColumnRenamed("n", "noise_n"), ["group", "stratum_type", "stratum_value"], "left")
    rows = rows.join(other_events.withColumnRenamed("events", "noise_events"), list(KEYS), "left")
    return rows.na.fill(0, ["events", "noise_n", "noise_events"]).withColumnRenamed("n", "n_patients")


def heterogeneity(counts: DataFrame) -> DataFrame:
    """(group, symptom, stratum_type, n_strata, chi2, heterogeneity_p): chi-square of events by stratum, with Yates' correction for two.

    Null for fewer than two strata, or when all or no patients have the event.
    """
    e, n = F.col("events").cast("double"), F.col("n_patients").cast("double")
    keys = ("group", "symptom", "stratum_type")
    live = counts.filter("n_patients > 0")
    totals = live.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_strata"), F.sum("events").alias("all_e"), F.sum("n_patients").alias("all_n"))
    share = F.col("all_e") / F.col("all_n")
    off = F.abs(e - n * share)
    # one cell's correction is at most its distance; both cells of a stratum are equally far off
    off = off - F.when(F.col("n_strata") == 2, F.least(F.lit(0.5), off)).otherwise(0.0)
    part = F.try_divide(off * off, n * share) + F.try_divide(off * off, n * (1 - share))
    rows = live.join(totals, list(keys)).groupBy(*keys).agg(F.first("n_strata").alias("n_strata"), F.first("all_e").alias("all_e"), F.first("all_n").alias("all_n"), F.sum(part).alias("chi2"))
    good = (F.col("n_strata") >= 2) & (F.col("all_e") > 0) & (F.col("all_e") < F.col("all_n"))
    chi2 = F.when(good, F.col("chi2"))
    return rows.select(*keys, "n_strata", chi2.alias("chi2"), chi2_pvalue(chi2, F.greatest(F.col("n_strata") - 1, F.lit(1))).alias("heterogeneity_p"))


def subgroups(signal: DataFrame, noise: DataFrame, covariates: DataFrame, columns: list[str], pairs: DataFrame | None = None) -> DataFrame:
    """The subgroup table: KEYS, n_patients, signal_pct, noise_pct, signal_minus_noise (2 decimals), heterogeneity_p (6)."""
    counts = strata_counts(signal, noise, strata_of(covariates, columns), pairs)
    s = 100.0 * F.col("events") / F.col("n_patients")
    k = F.coalesce(F.try_divide(100.0 * F.col("noise_events"), F.col("noise_n")), F.lit(0.0))
    rows = counts.join(heterogeneity(counts), ["group", "symptom", "stratum_type"], "left")
    return rows.select(*KEYS, "n_patients", F.round(s, 2).alias("signal_pct"), F.round(k, 2).alias("noise_pct"), F.round(s - k, 2).alias("signal_minus_noise"), F.round("heterogeneity_p", 6).alias("heterogeneity_p"))


def pairs_from_summary(rows: DataFrame) -> DataFrame:
    """The distinct (group, symptom) of a summary table, every row of it; the group may be in a column ``drug``."""
    group = F.coalesce(*(F.col(c) for c in ("group", "drug") if c in rows.columns))
    return rows.select(F.trim(group).alias("group"), F.trim("symptom").alias("symptom")).filter("symptom <> '' AND group <> ''").distinct()


__all__ = ["PAIR", "heterogeneity", "pairs_from_summary", "strata_counts", "strata_of", "subgroups"]
