"""Models against annotators: synonym groups, set F1, ground truth, model scores and agreement."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.terms import squeezed

#: Groups of terms that count as one.
SYNONYMS = (
    ("somnolence", "drowsiness", "sleepiness", "drowsy", "sleepy", "sedation"),
    ("dizziness", "lightheadedness", "lightheaded", "woozy", "vertigo"),
    ("fatigue", "tiredness", "tired", "exhaustion", "lethargy"),
    ("nausea", "nauseous", "nauseated", "queasiness"),
    ("headache", "cephalgia", "head pain"),
    ("insomnia", "sleeplessness", "difficulty sleeping", "trouble sleeping"),
    ("confusion", "disorientation", "disoriented", "confused"),
    ("irritability", "irritable", "agitation", "agitated"),
    ("anxiety", "anxious", "nervousness", "nervous"),
    ("depression", "depressed", "low mood", "depressed mood"),
    ("rash", "skin rash", "exanthem"),
    ("tremor", "tremors", "shaking", "shakiness"),
    ("weakness", "asthenia", "muscle weakness"),
    ("blurred vision", "blurry vision", "vision blurring"),
    ("diarrhea", "diarrhoea", "loose stools"),
    ("constipation", "infrequent stools"),
    ("vomiting", "emesis", "throwing up"),
    ("weight gain", "weight increase"),
    ("weight loss", "weight decrease"),
    ("appetite loss", "decreased appetite", "loss of appetite", "anorexia"),
    ("memory impairment", "memory loss", "forgetfulness", "memory problems"),
    ("paresthesia", "tingling", "numbness", "pins and needles"),
    ("palpitations", "racing heart", "heart racing"),
    ("dry mouth", "xerostomia"),
    ("itching", "pruritus", "itchiness"),
)


def canonical(term: Column, groups=SYNONYMS) -> Column:
    """The alphabetically first term of a term's group, else the term itself, in lower case and single-spaced."""
    key = squeezed(F.replace(F.lower(term), F.lit("_"), F.lit(" ")))
    known = {member: min(group) for group in groups for member in group}
    if not known:
        return key
    return F.coalesce(F.element_at(F.create_map(*map(F.lit, chain(*known.items()))), key), key)


def equivalent(a: Column, b: Column, groups=SYNONYMS) -> Column:
    """Whether two terms are the same or in one group."""
    return canonical(a, groups) == canonical(b, groups)


def set_scores(predicted: Column, truth: Column) -> Column:
    """struct(precision, recall, f1) of two arrays as sets; two empty sets agree fully."""
    p, t = F.array_distinct(predicted), F.array_distinct(truth)
    hits, n_p, n_t = F.size(F.array_intersect(p, t)), F.size(p), F.size(t)
    precision, recall = F.coalesce(F.try_divide(hits, n_p), F.lit(0.0)), F.coalesce(F.try_divide(hits, n_t), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * hits, n_p + n_t), F.lit(0.0))
    alike = (n_p == 0) & (n_t == 0)
    one = lambda c: F.when(alike, F.lit(1.0)).otherwise(c)
    return F.struct(one(precision).alias("precision"), one(recall).alias("recall"), one(f1).alias("f1"))


def votes(annotations: DataFrame, groups=SYNONYMS) -> tuple[DataFrame, DataFrame]:
    """Of (annotator, patient_id, terms): the (annotator, patient_id) roster, and the distinct canonical terms of each."""
    roster = annotations.select("annotator", "patient_id").distinct()
    said = annotations.select("annotator", "patient_id", F.explode("terms").alias("term"))
    return roster, said.withColumn("term", canonical(F.col("term"), groups)).distinct()


def ground_truth(annotations: DataFrame, mode: str = "union", groups=SYNONYMS) -> DataFrame:
    """(patient_id, terms): the terms that one (union), half or more (majority) or all (intersection) of a patient's annotators gave."""
    needed = {"union": F.lit(1.0), "majority": F.col("k") / 2, "intersection": F.col("k")}
    if mode not in needed:
        raise ValueError("mode must be union, majority or intersection")
    roster, terms = votes(annotations, groups)
    seen = roster.groupBy("patient_id").agg(F.count(F.lit(1)).alias("k"))
    kept = terms.groupBy("patient_id", "term").agg(F.count(F.lit(1)).alias("c")).join(seen, "patient_id").filter(F.col("c") >= needed[mode])
    lists = kept.groupBy("patient_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return seen.join(lists, "patient_id", "left").select("patient_id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))


def model_scores(extractions: DataFrame, truth: DataFrame, groups=SYNONYMS) -> DataFrame:
    """One row for each model of (model, patient_id, symptoms, extraction_time_s): macro_f1, symptomatic_f1, weighted_mae, mean_inference_s, bias.

    A truth patient without a record of the model has an empty prediction; other
    patients of the model count for its time alone.
    """
    models = extractions.groupBy("model").agg(F.avg("extraction_time_s").alias("mean_inference_s"))
    terms = extractions.select("model", "patient_id", F.explode("symptoms").alias("term"))
    terms = terms.withColumn("term", canonical(F.col("term"), groups)).distinct()
    lists = terms.groupBy("model", "patient_id").agg(F.collect_set("term").alias("predicted"))
    # Only patients with a prediction are joined; the others have F1 1 with an empty truth and 0 without, so totals give them.
    n_t = F.size("terms")
    totals = truth.agg(F.count(F.lit(1)).alias("n"), F.sum((n_t == 0).cast("int")).alias("n_empty"), F.sum(n_t).alias("n_terms"))
    f1 = set_scores(F.col("predicted"), F.col("terms"))["f1"]
    sums = lists.join(truth, "patient_id").groupBy("model").agg(F.sum(f1).alias("f1"), F.sum((n_t == 0).cast("int")).alias("met_empty"), F.sum(F.size("predicted")).alias("n_said"))
    # Prevalence errors weighted by the truth's rates: a term that a model never gives has the error r, so again only what it gives is joined.
    rates = truth.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("r"))
    squares = rates.agg(F.sum("r").alias("weights"), F.sum(F.col("r") * F.col("r")).alias("squares"))
    said = terms.join(truth.select("patient_id"), "patient_id", "left_semi").groupBy("model", "term").agg(F.count(F.lit(1)).alias("p"))
    p, r = F.col("p"), F.col("r")
    errors = said.join(rates, "term").groupBy("model").agg(F.sum(r * F.abs(p - r) - r * r).alias("error"))
    rows = models.join(sums, "model", "left").join(errors, "model", "left").na.fill(0, ["f1", "met_empty", "n_said", "error"]).crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(squares))  # one row each
    n, full = F.col("n"), F.col("n") - F.col("n_empty")
    out = rows.select(
        "model", "mean_inference_s",
        F.try_divide(F.col("f1") + F.col("n_empty") - F.col("met_empty"), n).alias("macro"), F.try_divide(F.col("f1"), full).alias("symptomatic"),
        F.try_divide(F.col("squares") + F.col("error"), F.col("weights") * n).alias("mae"), F.try_divide(F.col("n_said") - F.col("n_terms"), n).alias("bias"),
    )
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.select(
        "model", zero("macro").alias("macro_f1"), zero("symptomatic").alias("symptomatic_f1"), zero("mae").alias("weighted_mae"),
        F.round("mean_inference_s", 4).alias("mean_inference_s"), zero("bias").alias("bias"),
    )


# Agreement


def cohen_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, kappa) for two raters' labels; null without rows, 1 or 0 where chance agreement is full."""
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    total = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("c")).otherwise(0)).alias("same"))
    left, right = cells.groupBy("a").agg(F.sum("c").alias("x")), cells.groupBy("b").agg(F.sum("c").alias("y"))
    chance = left.join(right, left["a"].eqNullSafe(right["b"])).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    n, same, xy = F.col("n"), F.col("same"), F.col("xy")
    full = F.when(same >= n, 1.0).otherwise(0.0)
    kappa = F.when(xy >= n * n, full).otherwise(F.try_divide(F.try_divide(same, n) - F.try_divide(xy, n * n), 1 - F.try_divide(xy, n * n)))
    return total.crossJoin(chance).select(F.coalesce(n, F.lit(0)).alias("n"), F.when(n > 0, kappa).alias("kappa"))


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """One row (n_items, kappa) for (item, category, n) counts; items must have equally many ratings."""
    items = ratings.groupBy("item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    m = F.col("m")
    total = items.agg(F.count(F.lit(1)).alias("n_items"), F.min("m").alias("m"), F.max("m").alias("most"), F.avg(F.try_divide(F.col("squares") - m, m * (m - 1))).alias("p"))
    shares = ratings.groupBy("category").agg(F.sum("n").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum("c").alias("all"))
    e = F.try_divide(F.col("cc"), F.col("all") * F.col("all"))
    unequal = F.raise_error(F.lit("every item must have the same number of ratings")).cast("double")
    kappa = F.when(e >= 1, F.when(F.col("p") >= 1, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.col("p") - e, 1 - e))
    out = F.when(F.col("m") != F.col("most"), unequal).when((F.col("m") >= 2) & (F.col("n_items") > 0), kappa)
    return total.crossJoin(shares).select("n_items", out.alias("kappa"))


def krippendorff_alpha(values: DataFrame) -> DataFrame:
    """One row (n_items, alpha) for (item, rater, value), nominal; items with one value do not count."""
    cells = values.filter("value IS NOT NULL").groupBy("item", "value").agg(F.count(F.lit(1)).alias("n"))
    items = cells.groupBy("item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).filter("m >= 2")
    total = items.agg(F.count(F.lit(1)).alias("n_items"), F.sum("m").alias("n"), F.sum(F.col("m") - F.col("same") / (F.col("m") - 1)).alias("off"))
    margins = cells.join(items.select("item"), "item", "left_semi").groupBy("value").agg(F.sum("n").alias("v")).agg(F.sum(F.col("v") * F.col("v")).alias("vv"))
    n, off = F.col("n"), F.col("off")
    expected = (n * n - F.col("vv")) / (n - 1)
    # what sums of fractions leave of a zero is no disagreement
    alpha = F.when(expected == 0, F.when(F.abs(off) < 1e-9, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(off, expected))
    return total.crossJoin(margins).select("n_items", F.when(F.col("n_items") > 0, alpha).alias("alpha"))


def pairwise_f1(annotations: DataFrame, groups=SYNONYMS) -> DataFrame:
    """(a, b, f1, n): mean set F1 of each two annotators over the patients that both judged."""
    roster, terms = votes(annotations, groups)
    lists = terms.groupBy("annotator", "patient_id").agg(F.collect_set("term").alias("terms"))
    rows = roster.join(lists, ["annotator", "patient_id"], "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    left, right = (rows.select("patient_id", F.col("annotator").alias(x), F.col("terms").alias(f"t_{x}")) for x in "ab")
    both = left.join(right, "patient_id").filter("a < b")
    return both.groupBy("a", "b").agg(F.avg(set_scores(F.col("t_a"), F.col("t_b"))["f1"]).alias("f1"), F.count(F.lit(1)).alias("n"))


def agreement(annotations: DataFrame, groups=SYNONYMS) -> DataFrame:
    """One row: smallest, largest and mean pairwise F1, their number, and alpha over (patient, term) judgements of the patients that all judged."""
    pairs = pairwise_f1(annotations, groups).agg(F.min("f1").alias("f1_min"), F.max("f1").alias("f1_max"), F.avg("f1").alias("f1_mean"), F.count(F.lit(1)).alias("n_pairs"))
    roster, terms = votes(annotations, groups)
    raters = roster.select("annotator").distinct()
    k = raters.agg(F.count(F.lit(1)).alias("k"))
    shared = roster.groupBy("patient_id").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(k), F.col("c") == F.col("k")).select("patient_id")
    said = terms.join(shared, "patient_id", "left_semi")
    # each (patient, term of the vocabulary) is an item: how many of the k said yes; items that none said are counted, not made
    yes = said.groupBy("patient_id", "term").agg(F.count(F.lit(1)).alias("y"))
    sums = yes.crossJoin(F.broadcast(k)).agg(F.sum("y").alias("yes"), F.sum(F.when(F.col("k") > 1, 2.0 * F.col("y") * (F.col("k") - F.col("y")) / (F.col("k") - 1))).alias("off"))
    size = shared.agg(F.count(F.lit(1)).alias("n_patients")).crossJoin(said.agg(F.countDistinct("term").alias("n_terms"))).crossJoin(k)
    n, v = F.col("n_patients") * F.col("n_terms") * F.col("k"), F.col("yes")
    expected = F.try_divide(2.0 * v * (n - v), n - 1)
    alpha = F.when((F.col("k") < 2) | (n == 0), F.lit(None)).when(expected == 0, F.when(F.col("off") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(F.col("off"), expected))
    return pairs.crossJoin(sums).crossJoin(size).select("f1_min", "f1_max", "f1_mean", "n_pairs", "n_patients", "n_terms", alpha.alias("alpha"))


def lollipop_order(scores: DataFrame) -> DataFrame:
    """(model, metric, score, rank, leader) by the first quality column there is; lower is better for an error alone."""
    name = next((c for c in ("macro_f1", "symptomatic_f1", "weighted_mae") if c in scores.columns), None)
    if name is None:
        raise ValueError("no quality column")
    best = F.col("score").asc() if name == "weighted_mae" else F.col("score").desc()
    rows = scores.select("model", F.lit(name).alias("metric"), F.col(name).alias("score"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(best, "model")))  # a row for each model
    return ranked.withColumn("leader", F.col("rank") == 1)


def production_pick(scores: DataFrame) -> DataFrame:
    """The model to use: the fastest within the median time and median error, else the fastest within the error, else the fastest."""
    limits = scores.agg(F.expr("percentile(mean_inference_s, 0.5)").alias("t"), F.expr("percentile(weighted_mae, 0.5)").alias("e"))
    rows = scores.filter("mean_inference_s IS NOT NULL AND weighted_mae IS NOT NULL").crossJoin(F.broadcast(limits))
    right = F.col("weighted_mae") <= F.col("e")
    tier = F.when(right & (F.col("mean_inference_s") <= F.col("t")), 0).when(right, 1).otherwise(2)
    return rows.withColumn("tier", tier).orderBy("tier", "mean_inference_s", "model").limit(1).select("model", "tier")
