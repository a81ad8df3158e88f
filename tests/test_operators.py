import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import extract, indicators, mapping, panels, resample

RECORD = "group string, patient_id string, symptoms array<string>"


def test_arm(spark):
    rows = spark.createDataFrame([("g", "p", ["a"]), ("g", "p", ["b", None, "b"]), (None, "q", [])], RECORD).coalesce(1)
    roster, last = indicators.arm(rows)
    assert {tuple(r) for r in roster.collect()} == {("g", "p"), (None, "q")}
    assert {r.symptom for r in last.collect()} == {"b"}
    assert {r.symptom for r in indicators.arm(rows, "union")[1].collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        indicators.arm(rows, "x")


def test_null_safe_join(spark):
    a, b = (spark.createDataFrame(rows, f"k string, {c} int") for rows, c in (([(None, 1), ("x", 2)], "v"), ([(None, 3), ("y", 4)], "w")))
    got = {how: sorted(map(tuple, indicators.null_safe_join(a, b, ("k",), how).collect()), key=str) for how in ("inner", "left", "full")}
    assert got["inner"] == [(None, 1, 3)]
    assert got["left"] == sorted([(None, 1, 3), ("x", 2, None)], key=str)
    assert got["full"] == sorted([(None, 1, 3), ("x", 2, None), ("y", None, 4)], key=str)


RULES = [("(?:fever)", "fever"), (r"(?:\bpain)|(?:ache)", "pain")]


def test_build_mapping(spark):
    raw = ["Severe headache", "nausea/vomiting", "none", "afebrile fever", "mystery", "nausia", "back ache", "in left", "skip me", "mystery"]
    rows = mapping.build_mapping(spark.createDataFrame([(r,) for r in raw], "raw_term string"), ["Headache", "HEADACHE", "Nausea"], RULES, lambda batch: {"mystery": "solved case"}, {"SKIP ME"})
    got = {(r.raw_term, r.preprocessed_term): (r.normalized_term, r.tier) for r in rows.collect()}
    assert got == {
        ("Severe headache", "headache"): ("Headache", "ctcae"), ("nausea/vomiting", "nausea"): ("Nausea", "ctcae"), ("nausea/vomiting", "vomiting"): ("Vomiting", "llm"),
        ("none", ""): ("[FILTERED]", "filtered"), ("afebrile fever", "afebrile fever"): ("Fever", "rule"), ("mystery", "mystery"): ("Solved Case", "llm"),
        ("nausia", "nausia"): ("Nausia", "llm"), ("back ache", "back ache"): ("Pain", "rule"), ("in left", "in"): ("[FILTERED]", "filtered"), ("skip me", "skip me"): ("[FILTERED]", "filtered"),
    }
    ordered = mapping.ordered_mapping(rows).collect()
    assert [(r.normalized_term, r.raw_term) for r in ordered] == sorted((r.normalized_term, r.raw_term) for r in ordered)


def test_fuzzy_tier(spark):
    rows = mapping.vocabulary_match(spark.createDataFrame([("headaches",), ("Dizzy",), ("zzz",)], "term string"), ["Headache", "dizzy", "Dizzy"])
    assert {r.term: r.hit for r in rows.collect()} == {"headaches": "Headache", "Dizzy": "dizzy", "zzz": None}


def test_apply_mapping(spark):
    made = spark.createDataFrame([("r", "nausea", "Old", "rule"), ("r", "rash", "Rash", "rule"), ("s", "nausea", "Nausea", "llm"), ("t", "odd", "[FILTERED]", "filtered")], "raw_term string, preprocessed_term string, normalized_term string, tier string").coalesce(1)
    rows = spark.createDataFrame([("g", "p", ["Rash/nausea", "severe rash", "odd", "unknown", " "]), (None, "q", []), ("g", "r", None)], RECORD)
    got = {r.patient_id: (r.symptoms, r.symptoms_raw) for r in mapping.apply_mapping(rows, made).collect()}
    assert got == {"p": (["Nausea", "Rash"], ["Rash/nausea", "severe rash", "odd", "unknown", " "]), "q": ([], []), "r": ([], None)}


def test_rules(spark):
    rules = mapping.load_rules()
    assert len(rules) >= 40
    frame = spark.createDataFrame([("headache",), ("afebrile",), ("nothing here",)], "term string")
    by_column = {r.term: r.c for r in frame.select("term", mapping.rule_match(F.col("term"), rules).alias("c")).collect()}
    by_table = {r.term: r.canonical for r in mapping.first_rule(frame, mapping.rules_table(spark, rules)).collect()}
    assert by_column == {"headache": "Headache", "afebrile": None, "nothing here": None} and by_table == {"headache": "Headache"}


NOTES = "group string, patient_id string, pre_notes array<string>, post_notes array<string>"


def cohort(spark):
    rows = [("a", f"p{i}", [f"a{i}.{j}" for j in range(i % 4)], [f"post{i}.{j}" for j in range(3)]) for i in range(12)] + [("b", "alone", ["b0", "b1"], ["x"] * 5), (None, "n", ["n0"], []), (None, "m", ["m0"], ["z"]), ("c", "dry", [], ["x"])]
    return rows, spark.createDataFrame(rows, NOTES)


def test_surrogates(spark):
    rows, frame = cohort(spark)
    made = {(r.group, r.patient_id): r for r in resample.surrogates(frame, 1).collect()}
    again = {(r.group, r.patient_id): r for r in resample.surrogates(frame.repartition(5), 1).collect()}
    other = {(r.group, r.patient_id): r for r in resample.surrogates(frame, 2).collect()}
    assert made == again and made != other
    for group, pid, pre, post in rows:
        pool = [t for g, _, p, _ in rows if g == group for t in p]
        foreign = [t for t in pool if t not in pre]
        for want, got in ((pre, made[group, pid].pre_notes), (post, made[group, pid].post_notes)):
            assert len(got) == (len(want) if pool else 0)
            assert set(got) <= set(pool)
            if len(foreign) >= len(want):
                assert set(got) <= set(foreign) and len(set(got)) == len(got)


def test_extract(spark):
    rows = [("g", "p", ["rash noted"], ["rash, drowsy after Kepra"]), (None, "q", None, ["tired"])]
    prompts = extract.prompts(spark.createDataFrame(rows, NOTES), {"g": "drug g", "Kepra": "drug k"})
    assert "Kepra" not in prompts.first().prompt and "drug g" in prompts.filter("patient_id = 'p'").first().prompt
    got = {r.patient_id: r for r in extract.extract(prompts).collect()}
    assert got["p"].symptoms == ["drowsy"] and got["q"].symptoms == ["tired"] and got["p"].extraction_time_s >= 0

    class Broken:
        def generate(self, *_, **__):
            raise OSError("down")

    failed = extract.extract(prompts, Broken).collect()
    assert all(r.symptoms is None and r.error == "OSError: down" for r in failed)
    with pytest.raises(ValueError):
        extract.client_factory("x")


def test_selected(spark):
    rows = spark.createDataFrame([(f"p{i}",) for i in range(20)], "patient_id string").coalesce(1)
    ids = lambda df: [r.patient_id for r in df.collect()]
    assert ids(extract.selected(rows, 0, 3)) == ["p0", "p1", "p2"]
    shuffled = ids(extract.selected(rows, 5, 6))
    assert shuffled == ids(extract.selected(rows, 5, 6)) and shuffled != [f"p{i}" for i in range(6)]
    done = spark.createDataFrame([(shuffled[0],)], "patient_id string")
    assert sorted(ids(extract.selected(rows, 5, 6, done))) == sorted(shuffled[1:])


def test_panels(spark):
    rows = spark.createDataFrame([("a", "x", 2.0, True, "increased"), ("a", "y", -3.2, True, "decreased"), ("b", "x", 1.0, False, "increased"), ("c", "y", 9.0, None, None)], "group string, symptom string, signal_minus_noise double, significant boolean, direction string")
    assert [r.symptom for r in panels.symptom_order(rows).orderBy("position").collect()] == ["y", "x"]
    grid = {(r.group, r.symptom): r for r in panels.panels(rows).collect()}
    assert len(grid) == 6 and grid["b", "y"].delta == 0 and grid["a", "y"].sig_dec and not grid["a", "y"].sig and grid["a", "x"].sig and grid["a", "x"].ci_lo == 2.0
    pairs = {r.group: r for r in panels.row_pairs(panels.panels(rows)).collect()}
    assert (pairs["c"].row, pairs["a"].row, pairs["b"].row) == (0, 0, 1) and (pairs["a"].side, pairs["c"].side) == (1, 2)
    assert (pairs["a"].y_low, pairs["a"].y_high) == (-4.0, 9.5)
    assert [r.symptom for r in panels.top_signals(rows).collect()] == ["x", "y"]
    assert [r[0] for r in spark.range(28).select(panels.panel_label(F.col("id"))).collect()][25:] == ["Z", "27", "28"]
    table = panels.demographics_table(spark.createDataFrame([(1.25, "g", 3)], "x double, group string, n int"))
    assert table.columns == ["group", "x", "n"] and table.first().x == 1.3


def test_reference(spark):
    dumps = spark.createDataFrame([("g", 0, "Rash ", "unclear"), ("g", 1, "rash", "10%"), ("g", 2, "RASH", "50%"), ("g", 3, "itch", "0%")], "group string, pos int, term string, rate string")
    rates = panels.reference_rates(dumps)
    assert {(r.term, r.reference_rate) for r in rates.collect()} == {("rash", 10.0), ("itch", 0.0)}
    found = panels.reference_comparison(spark.createDataFrame([("g", "Rash", 20.0), ("h", "rash", 1.0), ("g", "Itch", 3.0)], "group string, symptom string, signal_pct double"), rates)
    fit = panels.reference_fit(found).first()
    assert (fit.n, fit.slope, fit.median_ratio) == (1, 2.0, 2.0)
    bins = panels.ratio_histogram(found).orderBy("bin").collect()
    assert len(bins) == 17 and bins[16].n == 1 and bins[16].high == pytest.approx(2.0)


def test_profiles(spark):
    matrix = spark.createDataFrame([("a", "1.0", 0.0), ("b", "2.0", -5.0), ("c", "x", 0.0), ("d", "0", 3.0)], "group string, s1 string, s2 double")
    d = {(r.a, r.b): r.distance for r in panels.cosine_distances(panels.profiles(matrix)).collect()}
    assert d["a", "b"] == pytest.approx(0) and d["a", "c"] == 1 and d["a", "d"] == pytest.approx(1)
    assert panels.dendrogram(matrix).first().left == ["a"]


def test_linkage():
    d = np.array([[0, 1, 4], [1, 0, 6], [4, 6, 0]])
    assert panels.average_linkage(["a", "b", "c"], d) == [(["a"], ["b"], 1.0), (["a", "b"], ["c"], 5.0)]
