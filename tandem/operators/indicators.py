"""Records of patients to long indicator tables.

Records have (group, patient_id, symptoms array). The roster is kept beside the
long table since patients without a symptom count in every denominator. A null
group is a group of its own: all joins on group are null-safe.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR = ("group", "patient_id")


def source_order(rows: DataFrame) -> Column:
    """What sorts rows as their source has them: file, place in the file, row; as they come where they are from no file."""
    row = F.monotonically_increasing_id()
    try:
        rows.select("_metadata.file_block_start").schema
    except AnalysisException:
        return row
    return F.struct("_metadata.file_path", "_metadata.file_block_start", row)


def last_records(records: DataFrame) -> DataFrame:
    """One record for each patient of a group: the last in the order of the source."""
    numbered = records.select(*PAIR, "symptoms", source_order(records).alias("at"))
    return numbered.groupBy(*PAIR).agg(F.max_by("symptoms", "at").alias("symptoms"))


def arm(records: DataFrame, duplicates: str = "last") -> tuple[DataFrame, DataFrame]:
    """(roster, long): the patients of each group, and each patient's distinct symptoms. duplicates: last or union."""
    if duplicates not in ("last", "union"):
        raise ValueError("duplicates must be last or union")
    rows = last_records(records) if duplicates == "last" else records
    long = rows.select(*PAIR, F.explode("symptoms").alias("symptom")).filter("symptom IS NOT NULL").distinct()
    return rows.select(*PAIR).distinct(), long


def null_safe_join(left: DataFrame, right: DataFrame, names: tuple[str, ...], how: str = "inner") -> DataFrame:
    """A join on columns where null equals null; the columns of the left side stay (of both, for a full join)."""
    renamed = right.select([F.col(c).alias(f"_{c}") if c in names else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(renamed[f"_{name}"])
    out = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return out
    if how in ("full", "right"):
        # a row of the right side alone has its key there
        lone = F.lit(True)
        for name in names:
            lone = lone & F.col(name).isNull()
        out = out.select(
            *(F.when(lone, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in left.columns),
            *(c for c in right.columns if c not in names),
        )
        return out
    return out.drop(*(f"_{n}" for n in names))
