"""A surrogate cohort without treatment: every window filled anew with other patients' earlier notes of the same group.

Contract: each patient keeps id, group and the sizes of both windows; all notes
come from the group's pool of pre-treatment notes; other patients' notes
without repetition where there are enough of them, else any notes of the pool
with repetition; an empty pool gives empty windows; the seed fixes the result.

A slot is a window's place for a note. The pool numbers a group's notes, a
patient's own consecutively, so the foreign notes are the numbers outside one
range: slot i of a window takes the i-th number of a keyed permutation of the
foreign numbers (a Feistel network walked until it falls inside), which needs no
list of the pool, and the slots meet the pool in one join on (group, number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _permuted(i: Column, size: Column, key: Column) -> Column:
    """Where a keyed permutation of the numbers below ``size`` takes i (cycle walking over the next even power of two)."""
    half = F.greatest(F.ceil(F.ceil(F.log2(F.greatest(size, F.lit(2)).cast("double"))) / 2), F.lit(1)).cast("int")
    left_by, right_by = (lambda x, name=name: F.call_function(name, x, half) for name in ("shiftleft", "shiftright"))
    mask = left_by(F.lit(1).cast("long")) - 1

    def once(x: Column) -> Column:
        left, right = right_by(x), x.bitwiseAND(mask)
        for turn in range(4):
            left, right = right, left.bitwiseXOR(F.xxhash64(key, F.lit(turn), right).bitwiseAND(mask))
        return left_by(left) + right

    # the domain is at most four times the size: 64 steps leave the range with a chance of 1e-8, and then the start stays
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(once(i).alias("x")), lambda s, _: F.struct(F.when(s["x"] < size, s["x"]).otherwise(once(s["x"])).alias("x")))["x"]
    return walked


def ranges(sizes: DataFrame, parts: int = 1024) -> DataFrame:
    """(g, p, begin, total): where a patient's notes begin in the pool of the group, and the pool's size, from (group, patient_id, n_pre).

    A group's patients are summed in ``parts`` parts by a hash of the id, so a
    group that holds a third of all patients is not one task.
    """
    rows = sizes.withColumn("part", F.pmod(F.xxhash64("patient_id"), F.lit(parts)))
    sums = rows.groupBy("group", "part").agg(F.sum("n_pre").alias("n"))
    before = lambda c, *keys: F.coalesce(F.sum(c).over(Window.partitionBy("group", *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("group").alias("g"), F.col("part").alias("q"), before("n", "part").alias("base"), F.sum("n").over(Window.partitionBy("group")).alias("total"))
    rows = rows.join(sums, F.col("group").eqNullSafe(F.col("g")) & (F.col("part") == F.col("q")))
    return rows.select("g", F.col("patient_id").alias("p"), (F.col("base") + before("n_pre", "part", "patient_id")).cast("long").alias("begin"), F.col("total").cast("long").alias("total"))


def pool(notes: DataFrame, at: DataFrame) -> DataFrame:
    """(g, k, text): a group's pre-treatment notes by number; a patient's own follow one another."""
    each = notes.select("group", "patient_id", F.posexplode("pre_notes").alias("pos", "text"))
    joined = each.join(at, F.col("group").eqNullSafe(F.col("g")) & (F.col("patient_id") == F.col("p")))
    return joined.select("g", (F.col("begin") + F.col("pos")).alias("k"), "text")


def surrogates(notes: DataFrame, seed: int = 0) -> DataFrame:
    """Notes (group, patient_id, pre_notes, post_notes) of the surrogate cohort; (group, patient_id) is one row."""
    empty = F.array().cast("array<string>")
    rows = notes.select("group", "patient_id", F.coalesce("pre_notes", empty).alias("pre_notes"), F.coalesce("post_notes", empty).alias("post_notes"))
    sizes = rows.select("group", "patient_id", F.size("pre_notes").alias("n_pre"), F.size("post_notes").alias("n_post"))
    at = ranges(sizes)
    sizes = sizes.join(at, F.col("group").eqNullSafe(F.col("g")) & (F.col("patient_id") == F.col("p"))).drop("g", "p")
    window = lambda name, n: F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.lit(name).alias("side"), i.alias("slot"), n.alias("want")))
    slots = sizes.select("group", "patient_id", "begin", "total", "n_pre", F.explode(F.concat(window("pre", F.col("n_pre")), window("post", F.col("n_post")))).alias("s")).filter("total > 0")
    foreign, i = F.col("total") - F.col("n_pre"), F.col("s.slot").cast("long")
    key = F.xxhash64(F.lit(seed), "group", "patient_id", F.col("s.side"))
    other = _permuted(i, foreign, key)
    number = F.when(foreign >= F.col("s.want"), F.when(other < F.col("begin"), other).otherwise(other + F.col("n_pre"))).otherwise(F.pmod(F.xxhash64(key, i), F.col("total")))
    wanted = slots.select("group", "patient_id", "s.side", "s.slot", number.alias("number"))
    drawn = wanted.join(pool(rows, at), F.col("group").eqNullSafe(F.col("g")) & (F.col("number") == F.col("k")))
    texts = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("slot", "text")))), lambda x: x["text"])
    windows = drawn.groupBy("group", "patient_id").agg(texts("pre").alias("pre_notes"), texts("post").alias("post_notes"))
    windows = windows.select(F.col("group").alias("g"), F.col("patient_id").alias("p"), "pre_notes", "post_notes")
    out = rows.select("group", "patient_id").join(windows, F.col("group").eqNullSafe(F.col("g")) & (F.col("patient_id") == F.col("p")), "left")
    return out.select("group", "patient_id", F.coalesce("pre_notes", empty).alias("pre_notes"), F.coalesce("post_notes", empty).alias("post_notes"))
