import math

import pytest
from pyspark.sql import functions as F

from tandem.operators import metrics, strata


def one(df):
    return df.first()


def test_canonical(spark):
    rows = spark.createDataFrame([("Sleepy",), ("low_mood",), ("Odd  Thing",), (None,)], "t string")
    assert [r[0] for r in rows.select(metrics.canonical(F.col("t"))).collect()] == ["drowsiness", "depressed", "odd thing", None]


def test_equivalent(spark):
    rows = spark.createDataFrame([("drowsy", "Sedation"), ("rash", "itch"), ("Own Term", "own_term")], "a string, b string")
    assert [r[0] for r in rows.select(metrics.equivalent(F.col("a"), F.col("b"))).collect()] == [True, False, True]


def test_set_scores(spark):
    rows = spark.createDataFrame([(["a", "b", "b"], ["b", "c", "d"]), ([], []), (["a"], []), ([], ["a"])], "p array<string>, t array<string>")
    got = [tuple(r[0]) for r in rows.select(metrics.set_scores(F.col("p"), F.col("t"))).collect()]
    assert got == [(0.5, pytest.approx(1 / 3), 0.4), (1, 1, 1), (0, 0, 0), (0, 0, 0)]


ANNOTATIONS = [("1", "p", ["sleepy", "rash"]), ("2", "p", ["drowsy"]), ("3", "p", ["drowsiness", "itch"]), ("1", "q", []), ("2", "q", ["rash"]), ("1", "r", [])]


def annotations(spark):
    return spark.createDataFrame(ANNOTATIONS, "annotator string, patient_id string, terms array<string>")


@pytest.mark.parametrize(
    ("mode", "wanted"),
    [("union", {"p": ["drowsiness", "exanthem", "itch"], "q": ["exanthem"], "r": []}), ("majority", {"p": ["drowsiness"], "q": ["exanthem"], "r": []}), ("intersection", {"p": ["drowsiness"], "q": [], "r": []})],
)
def test_ground_truth(spark, mode, wanted):
    assert {r.patient_id: r.terms for r in metrics.ground_truth(annotations(spark), mode).collect()} == wanted
    with pytest.raises(ValueError):
        metrics.ground_truth(annotations(spark), "x")


def test_model_scores(spark):
    truth = metrics.ground_truth(annotations(spark), "union")
    rows = [("m", "p", ["sleepiness", "fever"], 2.0), ("m", "zzz", ["rash"], 4.0), ("none", "p", [], None)]
    got = {r.model: r for r in metrics.model_scores(spark.createDataFrame(rows, "model string, patient_id string, symptoms array<string>, extraction_time_s double"), truth).collect()}
    # p: 1 of 2 right of 3; q: nothing of 1; r: both empty
    assert got["m"].macro_f1 == pytest.approx((0.4 + 0 + 1) / 3, abs=1e-6) and got["m"].symptomatic_f1 == pytest.approx(0.2)
    assert got["m"].bias == pytest.approx((-1 - 1 + 0) / 3, abs=1e-6) and got["m"].mean_inference_s == 3.0
    # rates of truth: drowsiness 1/3, exanthem 2/3, itch 1/3; the model's: 1/3, 0, 0
    assert got["m"].weighted_mae == pytest.approx((2 / 3 * 2 / 3 + 1 / 3 * 1 / 3) / (4 / 3), abs=1e-6)
    assert got["none"].mean_inference_s is None
    assert one(metrics.production_pick(spark.createDataFrame([("a", 1.0, 9.0), ("b", 5.0, 1.0), ("c", 9.0, 1.0)], "model string, mean_inference_s double, weighted_mae double"))).model == "b"
    order = metrics.lollipop_order(spark.createDataFrame([("a", 0.2), ("b", 0.1)], "model string, weighted_mae double")).collect()
    assert [(r.model, r.leader) for r in sorted(order, key=lambda r: r.rank)] == [("b", True), ("a", False)]
    with pytest.raises(ValueError):
        metrics.lollipop_order(truth)


def test_cohen(spark):
    rows = lambda a, b: spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int")
    assert one(metrics.cohen_kappa(rows([0, 1, 0, 1], [0, 1, 0, 1]), "a", "b")).kappa == pytest.approx(1)
    assert one(metrics.cohen_kappa(rows([0, 0, 1, 1], [0, 1, 0, 1]), "a", "b")).kappa == pytest.approx(0)
    assert one(metrics.cohen_kappa(rows([1, 1], [1, 1]), "a", "b")).kappa == 1.0
    assert one(metrics.cohen_kappa(rows([], []), "a", "b")).kappa is None


def test_fleiss(spark):
    rows = lambda table: spark.createDataFrame([(i, c, n) for i, r in enumerate(table) for c, n in enumerate(r)], "item int, category int, n int")
    assert one(metrics.fleiss_kappa(rows([[5, 0], [0, 5], [5, 0], [0, 5]]))).kappa == pytest.approx(1)
    # items: (4,1), (3,2), (5,0)
    p = (0.6 + 0.4 + 1) / 3
    e = (12 / 15) ** 2 + (3 / 15) ** 2
    assert one(metrics.fleiss_kappa(rows([[4, 1], [3, 2], [5, 0]]))).kappa == pytest.approx((p - e) / (1 - e))
    with pytest.raises(Exception, match="same number"):
        metrics.fleiss_kappa(rows([[4, 1], [3, 1]])).collect()


def alpha_of(matrix):
    pairs = {}
    for item in zip(*matrix, strict=True):
        held = [v for v in item if v is not None]
        for i, a in enumerate(held):
            for j, b in enumerate(held):
                if i != j:
                    pairs[a, b] = pairs.get((a, b), 0) + 1 / (len(held) - 1)
    n = sum(pairs.values())
    margin = {}
    for (a, _), c in pairs.items():
        margin[a] = margin.get(a, 0) + c
    off = sum(c for (a, b), c in pairs.items() if a != b)
    expected = sum(margin[a] * margin[b] for a in margin for b in margin if a != b) / (n - 1)
    return 1 - off / expected


def test_alpha(spark):
    matrix = [[1, 0, 1, None, 1, 2], [1, 1, 1, 0, None, 2], [0, 0, 1, 0, None, 2]]
    rows = spark.createDataFrame([(i, r, v) for r, row in enumerate(matrix) for i, v in enumerate(row)], "item int, rater int, value int")
    got = one(metrics.krippendorff_alpha(rows))
    assert (got.n_items, got.alpha) == (5, pytest.approx(alpha_of(matrix)))
    same = spark.createDataFrame([(i, r, 1) for r in range(2) for i in range(3)], "item int, rater int, value int")
    assert one(metrics.krippendorff_alpha(same)).alpha == 1.0
    assert one(metrics.krippendorff_alpha(same.limit(0))).alpha is None


def test_agreement(spark):
    rows = [("1", "p", ["rash", "itch"]), ("2", "p", ["rash"]), ("1", "q", ["fever"]), ("2", "q", ["cough"]), ("1", "r", []), ("2", "r", []), ("1", "x", ["rash"])]
    got = one(metrics.agreement(spark.createDataFrame(rows, "annotator string, patient_id string, terms array<string>"), ()))
    words = ["cough", "fever", "itch", "rash"]
    matrix = [[float(w in dict((p, t) for a, p, t in rows if a == k)[q]) for q in "pqr" for w in words] for k in "12"]
    assert (got.n_patients, got.n_terms, got.n_pairs) == (3, 4, 1)
    assert got.f1_mean == pytest.approx((2 / 3 + 0 + 1) / 3) and got.alpha == pytest.approx(alpha_of(matrix))


def test_strata(spark):
    record = "group string, patient_id string, symptoms array<string>"
    signal = [("g", str(i), ["x"] if i < 6 else []) for i in range(12)] + [("g", "0", ["y"]), (None, "z", ["x"])]
    noise = [("g", str(i), ["x"]) for i in range(2)]
    cov = spark.createDataFrame([(str(i), "a" if i % 2 else "b", " " if i == 11 else f"s{i % 3}") for i in range(12)] + [("z", "a", "s0")], "Patient_ID string, sex string, Site string")
    s, k = spark.createDataFrame(signal, record), spark.createDataFrame(noise, record)
    rows = {(r.group, r.symptom, r.stratum_type, r.stratum_value): r for r in strata.subgroups(s, k, cov, ["sex", "site"]).collect()}
    assert rows["g", "x", "sex", "a"].n_patients == 6 and rows["g", "x", "sex", "a"].signal_pct == 50.0 and rows["g", "x", "sex", "a"].noise_pct == 100.0
    assert rows["g", "x", "sex", "a"].heterogeneity_p == 1.0  # 3 of 6 in both
    assert rows["g", "y", "sex", "b"].signal_pct == pytest.approx(16.67)  # a second record of a patient counts too
    assert rows["", "x", "sex", "a"].heterogeneity_p is None
    assert rows["g", "x", "site", "s2"].n_patients == 3
    with pytest.raises(ValueError):
        strata.strata_of(cov, ["age"])
    # two strata: Yates' correction
    counts = spark.createDataFrame([("g", "x", "t", "a", 20, 5, 0, 0), ("g", "x", "t", "b", 20, 13, 0, 0)], "group string, symptom string, stratum_type string, stratum_value string, n_patients int, events int, noise_n int, noise_events int")
    got = strata.heterogeneity(counts).first()
    chi = sum((abs(o - 9) - 0.5) ** 2 * (1 / 9 + 1 / 11) for o in (5, 13))
    assert got.chi2 == pytest.approx(chi) and got.heterogeneity_p == pytest.approx(math.erfc(math.sqrt(chi / 2)))
    summary = spark.createDataFrame([("g", "x"), ("g", "x"), ("", "y"), ("h", " ")], "drug string, symptom string")
    assert [tuple(r) for r in strata.pairs_from_summary(summary).collect()] == [("g", "x")]
