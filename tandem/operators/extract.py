"""Extraction by a language model: patients to masked prompts, prompts to records.

A client is any object with ``generate(prompt, **options) -> str``, made by a
picklable factory once in each task. The default, KeywordClient, needs no
model. Backends that call a server or load a model are in this module too; they
import what they need when they are made.
"""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions.terms import fill_prompt, index_token, mask_names, no_leak, recovered_strings, window_text
from tandem.operators.metrics import SYNONYMS

TEMPLATE = """Two sets of notes follow, from before and after the start of {alias}.
List the symptoms that the later notes attribute to {alias}, or that are new or
worse in them without another cause. Leave out what was there before and is
unchanged, the treated condition itself, and findings without clinical weight.

=== BEFORE ===
{pre_notes}

=== AFTER ===
{post_notes}

Answer with JSON only: {"side_effects": ["symptom", "symptom"]}
"""
#: Settings of a call.
TEMPERATURE, MAX_TOKENS, CONTEXT, RETRIES, BACKOFF_S = 0.05, 4096, 131_072, 3, 2.0
RECORD = "patient_id string, group string, symptoms array<string>, raw_response string, extraction_time_s double, error string"


class KeywordClient:
    """A stand-in for a model: the known symptom words of the later notes that the earlier ones lack."""

    def __init__(self, words=tuple(w for group in SYNONYMS for w in group)):
        self.pattern = re.compile(r"\b(" + "|".join(sorted(map(re.escape, words), key=len, reverse=True)) + r")\b", re.IGNORECASE)

    def generate(self, prompt: str, **_) -> str:
        before, _, after = prompt.partition("=== AFTER ===")
        old = {w.lower() for w in self.pattern.findall(before)}
        found = dict.fromkeys(w.lower() for w in self.pattern.findall(after.rpartition("Answer with JSON")[0] or after))
        return json.dumps({"side_effects": [w for w in found if w not in old]})


class OllamaClient:
    """A model behind an HTTP server of this kind, with retries."""

    def __init__(self, model: str, url: str = "http://localhost:11434", context: int = CONTEXT):
        self.model, self.url, self.context = model, url, context

    def generate(self, prompt: str, temperature: float = TEMPERATURE, max_tokens: int = MAX_TOKENS) -> str:
        options = {"temperature": temperature, "num_predict": max_tokens, "num_ctx": self.context}
        body = json.dumps({"model": self.model, "prompt": prompt, "stream": False, "options": options}).encode()
        for attempt in range(RETRIES):
            try:
                request = urllib.request.Request(f"{self.url}/api/generate", body, {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=600) as answer:  # noqa: S310
                    return json.load(answer)["response"]
            except Exception as error:
                last = error
                time.sleep(BACKOFF_S * 2**attempt)
        raise RuntimeError(f"the model did not answer in {RETRIES} tries") from last


class MLXClient:
    """A model loaded into the worker, one for each."""

    def __init__(self, model: str):
        import mlx_lm

        self.library = mlx_lm
        self.model, self.tokenizer = mlx_lm.load(model)

    def generate(self, prompt: str, temperature: float = TEMPERATURE, max_tokens: int = MAX_TOKENS) -> str:
        return self.library.generate(self.model, self.tokenizer, prompt=prompt, max_tokens=max_tokens)


def client_factory(backend: str, model: str | None = None) -> Callable[[], object]:
    made = {"keyword": lambda: KeywordClient(), "ollama": lambda: OllamaClient(model), "mlx": lambda: MLXClient(model)}
    if backend not in made:
        raise ValueError(f"unknown backend {backend!r}")
    return made[backend]


def load_aliases(path: str) -> dict[str, str]:
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict):
        raise ValueError("the alias map must be a JSON object")
    return {str(k): str(v) for k, v in data.items()}


def selected(patients: DataFrame, seed: int = 0, limit: int | None = None, done: DataFrame | None = None) -> DataFrame:
    """Patients to run: shuffled by the seed (0: as they come), the first ``limit`` of them, then those already done left out."""
    rows = patients
    if seed:
        rows = rows.orderBy(F.xxhash64(F.lit(seed), "patient_id"), "patient_id")
    if limit is not None:
        rows = rows.limit(limit)
    return rows if done is None else rows.join(done.select("patient_id").distinct(), "patient_id", "left_anti")


def prompts(patients: DataFrame, aliases: Mapping[str, str], template: str = TEMPLATE) -> DataFrame:
    """(patient_id, group, prompt): windows joined, cut, masked and checked for names, then put into the template."""
    masked = lambda c: no_leak(mask_names(window_text(F.col(c)), aliases), aliases)
    prompt = fill_prompt(F.lit(template), index_token(F.col("group"), aliases), masked("pre_notes"), masked("post_notes"))
    return patients.select("patient_id", "group", prompt.alias("prompt"))


def extract(rows: DataFrame, factory: Callable[[], object] = KeywordClient, temperature: float = TEMPERATURE) -> DataFrame:
    """RECORD of each prompt; a patient whose call fails has an error and no symptoms. Write the result before using it twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = factory()
        for batch in batches:
            out = []
            for prompt in batch.column("prompt").to_pylist():
                begin = time.perf_counter()
                try:
                    answer = client.generate(prompt, temperature=temperature, max_tokens=MAX_TOKENS)
                    out.append((recovered_strings(answer, "side_effects"), answer, time.perf_counter() - begin, None))
                except Exception as error:
                    out.append((None, None, None, f"{type(error).__name__}: {error}"))
            symptoms, answers, seconds, errors = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("patient_id"), batch.column("group"), pa.array(symptoms, pa.list_(pa.string())), pa.array(answers, pa.string()), pa.array(seconds, pa.float64()), pa.array(errors, pa.string())],
                names=["patient_id", "group", "symptoms", "raw_response", "extraction_time_s", "error"],
            )

    cast = rows.select(F.col("patient_id").cast("string").alias("patient_id"), F.col("group").cast("string").alias("group"), "prompt")
    return cast.mapInArrow(run, RECORD)
