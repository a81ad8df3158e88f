import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from tandem import cli
from tandem.sources import files
from tandem.streaming.resume import extract_new


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n", encoding="utf-8")
    return str(path)


def table(path):
    (part,) = glob.glob(f"{path}/part-*.csv")
    return list(csv.DictReader(open(part, encoding="utf-8", newline="")))


def records(path):
    return [json.loads(x) for p in glob.glob(f"{path}/part-*.json") for x in open(p, encoding="utf-8")]


def test_notes(spark, tmp_path):
    for name, text in (("p 1/pre/b.txt", "second\nline"), ("p 1/pre/a.txt", "first"), ("p 1/post/c.txt", "after"), ("p2/post/c.txt", "x"), ("p2/other/c.txt", "no"), ("p2/pre.md", "no")):
        (tmp_path / "notes" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "notes" / name).write_text(text)
    got = {r.patient_id: r for r in files.read_notes(spark, str(tmp_path / "notes"), groups={"p2": "g"}).collect()}
    assert (got["p 1"].pre_notes, got["p 1"].post_notes, got["p 1"].group) == (["first", "second\nline"], ["after"], None)
    assert (got["p2"].pre_notes, got["p2"].post_notes, got["p2"].group) == ([], ["x"], "g")
    path = lines(tmp_path / "n.jsonl", [{"patient_id": "a", "pre_notes": ["x"]}, {"patient_id": "b", "group": "g", "post_notes": ["y"]}])
    rows = files.read_notes(spark, path)
    assert {r.patient_id: (r.pre_notes, r.post_notes, r.group) for r in rows.collect()} == {"a": (["x"], [], None), "b": ([], ["y"], "g")}
    assert files.get_patient(rows, "b").first().group == "g"
    with pytest.raises(ValueError):
        files.read_notes(spark, "x.csv")
    (tmp_path / "bad.jsonl").write_text('{"patient_id": "a"}\n{broken\n')
    with pytest.raises(Exception):
        files.read_notes(spark, str(tmp_path / "bad.jsonl")).collect()


def test_annotations_models_dumps(spark, tmp_path):
    (tmp_path / "ann").mkdir()
    (tmp_path / "ann" / "one.csv").write_text('﻿Patient_ID,Symptoms\np,"rash, itch ,"\nq,None\np,fever\n', encoding="utf-8")
    (tmp_path / "ann" / "two.csv").write_text('﻿Patient_ID,Symptoms\np,denies\n', encoding="utf-8")
    got = {(r.annotator, r.patient_id): r.terms for r in files.read_annotations(spark, str(tmp_path / "ann")).collect()}
    assert got == {("one", "p"): ["fever"], ("one", "q"): [], ("two", "p"): []}
    (tmp_path / "models").mkdir()
    lines(tmp_path / "models" / "m1.jsonl", [{"patient_id": "p", "symptoms": ["a"], "extraction_time_s": 2.0}])
    assert files.read_models(spark, str(tmp_path / "models")).first().model == "m1"
    (tmp_path / "dumps").mkdir()
    (tmp_path / "dumps" / "g.json").write_text('[{"term": "Rash", "rate": "5%"},\n {"term": "x", "rate": "?"}]')
    assert {(r.group, r.term) for r in files.read_dumps(spark, str(tmp_path / "dumps")).collect()} == {("g", "Rash"), ("g", "x")}


def test_done_ids(spark, tmp_path):
    assert files.done_ids(spark, str(tmp_path / "none")).count() == 0
    assert [r.patient_id for r in files.done_ids(spark, lines(tmp_path / "o.jsonl", [{"patient_id": "a"}, {"patient_id": "a"}])).collect()] == ["a"]


def test_command_line(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    notes = [{"patient_id": f"p{i}", "group": "Gcohort", "pre_notes": [f"note {i}", "well"], "post_notes": ["rash and Drowsy on Gname" if i % 3 else "fine"]} for i in range(12)]
    lines(tmp_path / "notes.jsonl", notes)
    (tmp_path / "alias.json").write_text('{"Gcohort": "drug g", "Gname": "drug g"}')
    run = lambda *a: cli.parser().parse_args(list(a)).run(spark, cli.parser().parse_args(list(a)))
    run("extract", "--notes", at("notes.jsonl"), "--alias-map", at("alias.json"), "--backend", "keyword", "--model", "none", "--out", at("signal"))
    assert len(records(at("signal"))) == 12
    run("extract", "--notes", at("notes.jsonl"), "--alias-map", at("alias.json"), "--backend", "keyword", "--model", "none", "--out", at("signal"), "--resume")
    assert len(records(at("signal"))) == 12
    run("noise", "--notes", at("notes.jsonl"), "--out", at("surrogate"), "--seed", "3")
    run("normalize", "build", "--in", at("signal"), "--out-mapping", at("mapping.csv"))
    assert {r["normalized_term"] for r in table(at("mapping.csv"))} == {"Rash", "Somnolence"}
    run("normalize", "apply", "--in", at("signal"), "--mapping", at("mapping.csv"), "--out", at("normal"))
    (tmp_path / "quiet").mkdir()
    lines(tmp_path / "quiet" / "n.json", [{"patient_id": f"p{i}", "group": "Gcohort", "symptoms": []} for i in range(12)])
    (tmp_path / "cov.csv").write_text("patient_id,sex,age\n" + "".join(f"p{i},{'mf'[i % 2]},{20 + i}\n" for i in range(12)))
    run("stats", "--signal", at("normal"), "--noise", at("quiet"), "--out-dir", at("out"), "--covariates", at("cov.csv"))
    summary = table(at("out/summary.csv"))
    assert {(r["symptom"], r["signal_pct"][:5], r["significant"]) for r in summary} == {("Rash", "66.66", "true"), ("Somnolence", "66.66", "true")}
    run("bayes", "--signal", at("normal"), "--noise", at("quiet"), "--out-dir", at("out"), "--draws", "500")
    assert all(r["bayes_significant"] == "true" for r in table(at("out/bayes_summary.csv")))
    run("subgroup", "--signal", at("normal"), "--noise", at("quiet"), "--covariates", at("cov.csv"), "--strata", "sex", "--top-from", at("out/summary.csv"), "--out", at("sub.csv"))
    assert len(table(at("sub.csv"))) == 4
    (tmp_path / "ann").mkdir()
    for k in "ab":
        (tmp_path / "ann" / f"{k}.csv").write_text("patient_id,symptoms\n" + "".join(f"p{i},{'rash' if i % 3 else ''}\n" for i in range(12)))
    (tmp_path / "models").mkdir()
    lines(tmp_path / "models" / "m.jsonl", [{"patient_id": f"p{i}", "symptoms": ["Rash"], "extraction_time_s": 1.0} for i in range(12)])
    run("benchmark", "--extractions", at("models"), "--annotations", at("ann"), "--out", at("bench.csv"))
    assert table(at("bench.csv"))[0]["macro_f1"] == "0.666667"
    (tmp_path / "dumps").mkdir()
    (tmp_path / "dumps" / "Gcohort.json").write_text('[{"term": "RASH", "rate": "10% to 30%"}]')
    run("reference", "--dumps", at("dumps"), "--signal", at("out/summary.csv"), "--out", at("ref.csv"))
    assert table(at("ref.csv"))[0]["reference_rate"] == "20.0"
    run("tables", "--signal", at("out/summary.csv"), "--demographics", at("cov.csv"), "--out-dir", at("tables"))
    assert len(table(at("tables/table2.csv"))) == 2 and len(table(at("tables/table1.csv"))) == 12
    run("figures", "--out-dir", at("fig"), "--signal", at("out/summary.csv"), "--benchmark", at("bench.csv"), "--reference", at("ref.csv"))
    assert len(table(at("fig/signal_grid.csv"))) == 2 and table(at("fig/benchmark_lollipop.csv"))[0]["leader"] == "true"
    with pytest.raises(ValueError):
        run("figures", "--out-dir", at("fig"), "--which", "nothing")


def test_resumed_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    note = lambda p: {"patient_id": p, "pre_notes": [], "post_notes": ["itching"], "group": None}
    go = lambda: extract_new(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), {}).awaitTermination(120)
    lines(tmp_path / "in" / "a.json", [note("a"), note("b")])
    go()
    lines(tmp_path / "in" / "b.json", [note("b"), note("c")])
    go()
    rows = spark.read.json(str(tmp_path / "out"))
    assert sorted(r.patient_id for r in rows.collect()) == ["a", "b", "c"] and rows.select(F.explode("symptoms")).distinct().count() == 1


def test_last_record_in_file_order(spark, tmp_path):
    """Of a patient's records the last in the order of files and lines counts, however Spark packs the files."""
    from tandem.operators.indicators import last_records
    from tandem.sources.files import EXTRACTIONS, read_annotations, read_jsonl

    big = "".join('{"patient_id": "%d", "group": "g", "symptoms": ["old", "%s"]}\n' % (i, "x" * 200) for i in range(300))
    (tmp_path / "a.jsonl").write_text(big)
    (tmp_path / "b.jsonl").write_text('{"patient_id": "7", "group": "g", "symptoms": ["middle"]}\n{"patient_id": "7", "group": "g", "symptoms": ["new"]}\n')
    rows = last_records(read_jsonl(spark, [str(tmp_path / "b.jsonl"), str(tmp_path / "a.jsonl")], EXTRACTIONS))
    assert rows.filter("patient_id = '7'").first().symptoms == ["new"] and rows.count() == 300
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "one.csv").write_text("patient_id,symptoms\n1,a\n1,\"b, c\"\n")
    assert [(r.annotator, r.terms) for r in read_annotations(spark, str(tmp_path / "n")).collect()] == [("one", ["b", "c"])]
