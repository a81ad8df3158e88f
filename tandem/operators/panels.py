"""The tables behind figures and reports: ordering, panels, row pairs, reference rates, profiles, clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.terms import rate_midpoint


def present(rows: DataFrame, column: str, default) -> DataFrame:
    """rows with the column, filled with a default where there is none."""
    return rows if column in rows.columns else rows.withColumn(column, F.lit(default))


def symptom_order(rows: DataFrame) -> DataFrame:
    """(symptom, n_significant, mean_delta, position): most significant groups first, then the largest mean."""
    rows = present(present(rows, "significant", False), "signal_minus_noise", 0.0)
    agg = rows.groupBy("symptom").agg(F.sum(F.coalesce("significant", F.lit(False)).cast("int")).alias("n_significant"), F.avg("signal_minus_noise").alias("mean_delta"))
    order = Window.orderBy(F.col("n_significant").desc(), F.col("mean_delta").desc(), "symptom")  # a row for each symptom
    return agg.withColumn("position", F.row_number().over(order))


def panels(rows: DataFrame) -> DataFrame:
    """(group, symptom, delta, sig, sig_dec, ci_lo, ci_hi): every group with every symptom, zero where it has none."""
    for name, default in (("signal_minus_noise", 0.0), ("significant", False), ("direction", "increased")):
        rows = present(rows, name, default)
    delta = F.coalesce("signal_minus_noise", F.lit(0.0))
    low, high = (F.coalesce(F.col(c) if c in rows.columns else F.lit(None).cast("double"), delta) for c in ("diff_ci_lower", "diff_ci_upper"))
    sig, down = F.coalesce("significant", F.lit(False)), F.lower(F.coalesce("direction", F.lit("increased"))) == "decreased"
    own = rows.withColumn("_at", F.monotonically_increasing_id()).groupBy("group", "symptom").agg(
        F.min_by(F.struct(delta.alias("delta"), (sig & ~down).alias("sig"), (sig & down).alias("sig_dec"), low.alias("ci_lo"), high.alias("ci_hi")), "_at").alias("v")
    )
    # the grid of a figure: groups and symptoms are few
    grid = rows.select("group").distinct().crossJoin(rows.select("symptom").distinct())
    zero = F.lit(0.0)
    found = grid.join(own, ["group", "symptom"], "left")
    flag = lambda c: F.coalesce(F.col(f"v.{c}"), F.lit(False)).alias(c)
    return found.select("group", "symptom", F.coalesce("v.delta", zero).alias("delta"), flag("sig"), flag("sig_dec"), *(F.coalesce(f"v.{c}", zero).alias(c) for c in ("ci_lo", "ci_hi")))


def row_pairs(grid: DataFrame) -> DataFrame:
    """(group, reach, row, side, y_low, y_high): groups of similar reach two by two, with their common range in halves."""
    reach = grid.groupBy("group").agg(F.max(F.abs("delta")).alias("reach"), F.min(F.least("ci_lo", "delta", F.lit(0.0))).alias("lo"), F.max(F.greatest("ci_hi", "delta", F.lit(0.0))).alias("hi"))
    rank = F.row_number().over(Window.orderBy(F.col("reach").desc(), "group"))  # a row for each group
    rows = reach.withColumn("row", F.floor((rank - 1) / 2).cast("int"))
    pair = Window.partitionBy("row")
    return rows.select(
        "group", "reach", "row", F.row_number().over(pair.orderBy("group")).alias("side"),
        (F.floor((F.min("lo").over(pair) - 0.5) * 2) / 2).alias("y_low"), (F.ceil((F.max("hi").over(pair) + 0.5) * 2) / 2).alias("y_high"),
    )


def panel_label(index):
    """Letters from A, then numbers, for an index from 0."""
    return F.when(index < 26, F.char(F.lit(65) + index)).otherwise((index + 1).cast("string"))


def reference_rates(dumps: DataFrame) -> DataFrame:
    """(group, term, reference_rate) of (group, pos, term, rate): the first rate of a term that can be read."""
    rows = dumps.select("group", F.lower(F.trim("term")).alias("term"), "pos", rate_midpoint(F.col("rate")).alias("rate"))
    rows = rows.filter("rate IS NOT NULL AND term <> ''")
    return rows.groupBy("group", "term").agg(F.min_by("rate", "pos").alias("reference_rate"))


def reference_comparison(rows: DataFrame, rates: DataFrame, source: str = "reference") -> DataFrame:
    """(group, symptom, observed_signal_pct, reference_rate, source) of the signals that have a published rate."""
    found = rows.withColumn("term", F.lower(F.trim("symptom"))).join(rates, ["group", "term"])
    return found.select("group", "symptom", F.col("signal_pct").alias("observed_signal_pct"), "reference_rate", F.lit(source).alias("source"))


def reference_fit(comparison: DataFrame) -> DataFrame:
    """One row: n, the slope of observed on reference through the origin, median and 95th percentile of their ratio."""
    rows = comparison.filter("coalesce(reference_rate, 0) > 0").withColumn("ratio", F.col("observed_signal_pct") / F.col("reference_rate"))
    x, y = F.col("reference_rate"), F.col("observed_signal_pct")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.sum(x * y), F.sum(x * x)).alias("slope"),
        F.expr("percentile(ratio, 0.5)").alias("median_ratio"), F.expr("percentile(ratio, 0.95)").alias("p95_ratio"),
    )


def ratio_histogram(comparison: DataFrame, bins: int = 17) -> DataFrame:
    """(bin, low, high, n) of the ratios from 0 to their 95th percentile or 1.2, the last bin closed; ratios beyond are out."""
    rows = comparison.filter("coalesce(reference_rate, 0) > 0").select((F.col("observed_signal_pct") / F.col("reference_rate")).alias("ratio"))
    top = rows.agg(F.greatest(F.lit(1.2), F.expr("percentile(ratio, 0.95)")).alias("top"))
    rows = rows.crossJoin(F.broadcast(top)).filter("ratio <= top")
    at = F.least(F.floor(F.col("ratio") / (F.col("top") / bins)), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = top.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "top")
    return frame.join(counts, "bin", "left").select("bin", (F.col("top") / bins * F.col("bin")).alias("low"), (F.col("top") / bins * (F.col("bin") + 1)).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def top_signals(rows: DataFrame, top_n: int = 25) -> DataFrame:
    """The significant signals with the largest difference."""
    if "significant" in rows.columns:
        rows = rows.filter(F.coalesce("significant", F.lit(False)))
    names = [c for c in ("group", "symptom", "signal_pct", "signal_minus_noise", "q_value") if c in rows.columns]
    return rows.orderBy(F.col("signal_minus_noise").desc(), "group", "symptom").limit(top_n).select(*names)


def demographics_table(rows: DataFrame) -> DataFrame:
    """All columns, group first, floating-point ones to one decimal."""
    floats = {n for n, t in rows.dtypes if t in ("double", "float")}
    order = [c for c in rows.columns if c == "group"] + [c for c in rows.columns if c != "group"]
    return rows.select(*(F.round(c, 1).alias(c) if c in floats else F.col(c) for c in order))


def profile_matrix(rows: DataFrame) -> DataFrame:
    """group and a column for each symptom: signal minus noise."""
    return rows.groupBy("group").pivot("symptom").agg(F.first("signal_minus_noise"))


def profiles(matrix: DataFrame) -> DataFrame:
    """(label, profile): the first column, and the others as numbers, nothing below zero or unreadable."""
    label, *names = matrix.columns
    values = [F.greatest(F.lit(0.0), F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0))) for c in names]
    return matrix.select(F.col(label).cast("string").alias("label"), F.array(*values).alias("profile"))


def cosine_distances(rows: DataFrame) -> DataFrame:
    """(a, b, distance) of each two profiles, a < b; 1 from a profile of zeros."""
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    unit = rows.withColumn("norm", F.sqrt(add(F.transform("profile", lambda x: x * x))))
    left, right = (unit.select(F.col("label").alias(x), F.col("profile").alias(f"p_{x}"), F.col("norm").alias(f"n_{x}")) for x in "ab")
    both = left.join(right, F.col("a") < F.col("b"))  # a row for each group of patients
    dot = add(F.zip_with("p_a", "p_b", lambda x, y: x * y))
    like = F.coalesce(F.try_divide(dot, F.col("n_a") * F.col("n_b")), F.lit(0.0))
    return both.select("a", "b", (1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), like))).alias("distance"))


def average_linkage(labels: list[str], distance: np.ndarray) -> list[tuple[list[str], list[str], float]]:
    """Merges (members, members, height) of average-linkage clustering of a few groups."""
    clusters = {i: [i] for i in range(len(labels))}
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    out = []
    while len(clusters) > 1:
        live = sorted(clusters)
        sub = d[np.ix_(live, live)]
        i, j = (live[k] for k in np.unravel_index(sub.argmin(), sub.shape))
        out.append(([labels[k] for k in clusters[i]], [labels[k] for k in clusters[j]], float(d[i, j])))
        a, b = len(clusters[i]), len(clusters[j])
        d[i] = d[:, i] = (a * d[i] + b * d[j]) / (a + b)
        d[i, i] = np.inf
        clusters[i] += clusters.pop(j)
    return out


def dendrogram(matrix: DataFrame) -> DataFrame:
    """(step, left, right, height): the merges of the groups of a profile matrix (a row for each group of patients)."""
    spark = matrix.sparkSession
    rows = cosine_distances(profiles(matrix)).toPandas()
    labels = sorted({*rows["a"], *rows["b"]})
    at = {x: i for i, x in enumerate(labels)}
    d = np.zeros((len(labels), len(labels)))
    for a, b, value in rows.itertuples(index=False):
        d[at[a], at[b]] = d[at[b], at[a]] = value
    merges = [(i, a, b, h) for i, (a, b, h) in enumerate(average_linkage(labels, d))]
    return spark.createDataFrame(merges, "step int, left array<string>, right array<string>, height double")
