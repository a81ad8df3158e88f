"""Exact dedup by progressive refinement, in DataFrame functions alone.

Two texts are equal when they are identical after every character of
``[\\x20\\x09-\\x0D]`` is deleted. The refinement goes length, then hash of the
first ``prefix`` characters, then SHA-256 of all: each level looks only at rows
that share the level before with another row. Of equal texts the row with the
most code points in its original text, then the smallest id, stays.

Each level is a count with map-side combine over narrow rows (id, length,
hashes), followed by a join of two plainly shuffled sides that Spark can split
where one group holds a third of all rows; no group is gathered anywhere.

Full digests are read in one of two ways:

* ``digest_all=False``: a second scan hashes only the rows of surviving groups.
  Their keys are broadcast when there are at most ``broadcast_rows`` of them;
  beyond that the digest is computed in a scan of all rows, since moving the
  texts through a shuffle to save hashing them costs more.
* ``digest_all=True``: for callers that want every row's digest anyway.

Defined results: null counts as empty; empty texts are one group; repeated
rows with one id are separate rows of their group, and among them any is the
row that stays (they carry one id, so all of them are marked kept); rows with
a null id are never chosen over others of equal length. Columns other than id
and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.storage import stored

SPACES = " \t\n\x0b\x0c\r"
NO_ID = (1 << 63) - 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


def refined(docs: DataFrame, prefix: int = 256, digest_all: bool = False, broadcast_rows: int = 500_000) -> DataFrame:
    """Narrow rows: doc_id, n_chars, norm_len, head (hash of the prefix), text_sha256 (null if none was needed)."""
    norm = normalised(F.col("text"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), norm.alias("norm")
    )
    head = F.xxhash64(F.substring("norm", 1, prefix)).alias("head")
    narrow = ["doc_id", "n_chars", F.length("norm").alias("norm_len"), head]
    full = F.sha2(F.col("norm").cast("binary"), 256)
    if digest_all:
        return stored(base.select(*narrow, full.alias("text_sha256")), "digests")
    level = stored(base.select(*narrow), "lengths")
    level_1 = _shared(level.select("norm_len"), "norm_len")
    level_2 = stored(_shared(level.join(level_1, "norm_len", "left_semi").select("norm_len", "head"), "norm_len", "head"), "heads")
    if level_2.count() > broadcast_rows:
        return stored(base.select(*narrow, full.alias("text_sha256")), "digests")
    wanted = F.broadcast(level_2.withColumn("wanted", F.lit(True)))
    second = base.select(*narrow, "norm").join(wanted, ["norm_len", "head"], "left")
    return stored(second.select("doc_id", "n_chars", "norm_len", "head", F.when(F.col("wanted"), full).alias("text_sha256")), "digests")


def exact_dedup(docs: DataFrame, prefix: int = 256, digest_all: bool = False, broadcast_rows: int = 500_000) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (see refined())."""
    rows = refined(docs, prefix, digest_all, broadcast_rows)
    level_1 = _shared(rows.select("norm_len"), "norm_len")
    level_2 = _shared(rows.join(level_1, "norm_len", "left_semi").select("norm_len", "head"), "norm_len", "head")
    alive = rows.join(level_2, ["norm_len", "head"], "left_semi")
    ident = F.coalesce("doc_id", F.lit(NO_ID))
    best = F.max_by("doc_id", F.struct("n_chars", -ident))
    groups = stored(
        alive.groupBy("norm_len", "head", "text_sha256")
        .agg(F.count(F.lit(1)).alias("group_size"), best.alias("keep_id"))
        .filter("group_size > 1"),
        "groups",
    )
    keys = ["norm_len", "head", "text_sha256"]
    return rows.join(groups, keys, "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_id").eqNullSafe(F.col("doc_id")) | F.col("group_size").isNull(), F.lit(False)).alias("kept"),
        "text_sha256",
    )
