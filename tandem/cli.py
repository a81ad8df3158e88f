"""Command line: each stage reads and writes files, as the functions of this package do with DataFrames."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tandem", description="Paired-signal analytics on Spark.")
    sub = top.add_subparsers(dest="command", required=True)

    def stage(name: str, run, *required: str, within=sub, **optional):
        at = within.add_parser(name)
        for option in required:
            at.add_argument(f"--{option}", required=True)
        for option, default in optional.items():
            kind = {"action": "store_true"} if default is False else {"default": default, "type": type(default) if default is not None else str}
            at.add_argument(f"--{option.replace('_', '-')}", **kind)
        at.set_defaults(run=run)
        return at

    at = stage("extract", extract, "notes", "alias-map", "model", "out", prompt=None, backend="ollama", seed=0, temperature=0.05, num_ctx=131_072, resume=False)
    at.add_argument("--limit", type=int)
    normalize = sub.add_parser("normalize").add_subparsers(dest="subcommand", required=True)
    at = stage("build", build, "out-mapping", within=normalize, ctcae=None, rules=None, backend="ollama", model=None)
    at.add_argument("--in", nargs="+", required=True, dest="inputs")
    at = stage("apply", apply, "mapping", "out", within=normalize)
    at.add_argument("--in", required=True, dest="input")
    stage("noise", noise, "notes", "out", seed=0)
    at = stage("stats", stats, "signal", "noise", "out-dir", fdr_q=0.10, alpha=0.05, covariates=None, seed=0)
    at.add_argument("--scope", default="within-drug", choices=["within-drug", "global"])
    stage("bayes", bayes, "signal", "noise", "out-dir", draws=10_000, threshold=0.95, seed=0)
    stage("subgroup", subgroup, "signal", "noise", "covariates", "out", strata="institution,sex,age", top_from=None)
    at = stage("benchmark", benchmark, "extractions", "annotations", "out")
    at.add_argument("--gt-mode", default="union", choices=["union", "majority", "intersection"])
    stage("reference", reference, "dumps", "signal", "out")
    stage("figures", figures, "out-dir", which="all", signal=None, benchmark=None, reference=None, matrix=None)
    stage("tables", tables, "signal", "out-dir", demographics=None)
    return top


def extract(spark, a):
    from tandem.operators.extract import TEMPLATE, client_factory, load_aliases, prompts, selected
    from tandem.operators.extract import extract as run
    from tandem.sources.files import done_ids, read_notes, write_jsonl

    aliases = load_aliases(a.alias_map)
    rows = selected(read_notes(spark, a.notes), a.seed, a.limit, done_ids(spark, a.out) if a.resume else None)
    template = open(a.prompt, encoding="utf-8").read() if a.prompt else TEMPLATE
    found = run(prompts(rows, aliases, template), client_factory(a.backend, a.model), a.temperature)
    write_jsonl(found.filter("error IS NULL").drop("error"), a.out, "append" if a.resume else "overwrite")


def build(spark, a):
    from tandem.functions.terms import recovered_json
    from tandem.operators.extract import client_factory
    from tandem.operators.mapping import build_mapping, load_rules, load_vocabulary, ordered_mapping
    from tandem.sources.files import EXTRACTIONS, read_jsonl, write_csv

    raw = read_jsonl(spark, a.inputs, EXTRACTIONS).select(F.explode("symptoms").alias("raw_term")).filter("trim(raw_term) <> ''")
    vocabulary = load_vocabulary(a.ctcae) if a.ctcae else []
    answer = None
    if a.model:
        factory = client_factory(a.backend, a.model)

        def answer(terms: list[str]) -> dict[str, str]:
            ask = f"Give each term its standard symptom name, from the vocabulary where one fits. Answer with JSON only: {{\"mapping\": {{term: name}}}}\nVocabulary: {sorted(vocabulary)}\nTerms: {terms}"
            data = recovered_json(factory().generate(ask, temperature=0.0))
            data = data.get("mapping", data) if isinstance(data, dict) else {}
            return {k: v.strip() for k, v in data.items() if isinstance(v, str) and v.strip()}

    write_csv(ordered_mapping(build_mapping(raw, vocabulary, load_rules(a.rules), answer)), a.out_mapping)


def apply(spark, a):
    from tandem.operators.mapping import apply_mapping
    from tandem.sources.files import EXTRACTIONS, read_jsonl, read_mapping, write_jsonl

    rows = read_jsonl(spark, a.input, EXTRACTIONS).select("patient_id", "group", "symptoms")
    write_jsonl(apply_mapping(rows, read_mapping(spark, a.mapping)), a.out)


def noise(spark, a):
    from tandem.operators.resample import surrogates
    from tandem.sources.files import read_notes, write_jsonl

    write_jsonl(surrogates(read_notes(spark, a.notes), a.seed), a.out)


def _arms(spark, a):
    from tandem.sources.files import NORMALIZED, read_jsonl

    return read_jsonl(spark, a.signal, NORMALIZED), read_jsonl(spark, a.noise, NORMALIZED)


def stats(spark, a):
    from tandem.operators import paired
    from tandem.sources.files import read_covariates, write_csv

    covariates = read_covariates(spark, a.covariates) if a.covariates else None
    rows = paired.stats(*_arms(spark, a), a.fdr_q, a.alpha, a.scope, covariates).cache()
    write_csv(rows.orderBy(F.col("signal_minus_noise").desc(), "symptom"), f"{a.out_dir}/stats", by="group")
    write_csv(paired.summary(rows), f"{a.out_dir}/summary.csv")


def bayes(spark, a):
    from tandem.operators import paired
    from tandem.sources.files import write_csv

    rows = paired.bayes(*_arms(spark, a), a.draws, a.threshold, a.seed).cache()
    order = (F.col("posterior_prob_signal_gt_noise").desc(), "symptom")
    write_csv(rows.orderBy(*order), f"{a.out_dir}/bayes", by="group")
    write_csv(rows.orderBy(F.col("group").asc_nulls_last(), *order), f"{a.out_dir}/bayes_summary.csv")


def subgroup(spark, a):
    from tandem.operators.strata import KEYS, pairs_from_summary, subgroups
    from tandem.sources.files import read_csv, write_csv

    pairs = pairs_from_summary(read_csv(spark, a.top_from)) if a.top_from else None
    columns = [c.strip() for c in a.strata.split(",") if c.strip()]
    write_csv(subgroups(*_arms(spark, a), read_csv(spark, a.covariates), columns, pairs).orderBy(*KEYS), a.out)


def benchmark(spark, a):
    from tandem.operators.metrics import agreement, ground_truth, model_scores
    from tandem.sources.files import read_annotations, read_models, write_csv

    annotations = read_annotations(spark, a.annotations)
    agreement(annotations).show(truncate=False)
    write_csv(model_scores(read_models(spark, a.extractions), ground_truth(annotations, a.gt_mode)).orderBy("model"), a.out)


def reference(spark, a):
    from tandem.operators.panels import reference_comparison, reference_rates
    from tandem.sources.files import read_csv, read_dumps, write_csv

    write_csv(reference_comparison(read_csv(spark, a.signal, infer=True), reference_rates(read_dumps(spark, a.dumps))), a.out)


def figures(spark, a):
    """The data of each figure as a table; a figure whose input is missing is skipped."""
    from tandem.operators import metrics, panels
    from tandem.sources.files import read_csv, write_csv

    made = {
        "signal_grid": (a.signal, lambda x: panels.panels(x)),
        "row_pairs": (a.signal, lambda x: panels.row_pairs(panels.panels(x))),
        "benchmark_lollipop": (a.benchmark, metrics.lollipop_order),
        "time_vs_efficacy": (a.benchmark, metrics.production_pick),
        "noise_vs_literature": (a.reference, panels.reference_fit),
        "dendrogram": (a.matrix, lambda x: panels.dendrogram(x).withColumn("left", F.array_join("left", "|")).withColumn("right", F.array_join("right", "|"))),
    }
    if a.which != "all" and a.which not in made:
        raise ValueError(f"unknown figure {a.which!r}")
    for name, (path, table) in made.items():
        if path and a.which in ("all", name):
            write_csv(table(read_csv(spark, path, infer=True)), f"{a.out_dir}/{name}.csv")


def tables(spark, a):
    from tandem.operators.panels import demographics_table, top_signals
    from tandem.sources.files import read_csv, write_csv

    if a.demographics:
        write_csv(demographics_table(read_csv(spark, a.demographics, infer=True)), f"{a.out_dir}/table1.csv")
    write_csv(top_signals(read_csv(spark, a.signal, infer=True)), f"{a.out_dir}/table2.csv")


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(SparkSession.builder.appName("tandem").getOrCreate(), a)


if __name__ == "__main__":
    main()
