"""Secret scans, in DataFrame functions alone.

Three base kinds are found by pattern, leftmost and without overlap within a
kind: ``assign`` (a password-like name, a sign and a value of 6 characters or
more), ``access`` (``AKIA`` and capitals or digits, 20 or more in all) and
``hex`` (24 or more hex digits).

A fourth kind, ``entropy``, is found by a sliding window. Candidates are runs
of 24 or more characters of ``[A-Za-z0-9+/_=-]`` that hold a digit. A candidate
is of the class ``hex`` (hex digits alone), ``base36`` (one letter case and
digits) or ``base64`` (the rest). Along it runs a window of ``width``
characters whose Shannon entropy follows from counts updated by one character
in and one out; the candidate is reported as soon as one window reaches the
threshold of its class. Left out (the allow list): candidates with a run of
letters and no more than two digits (words), UUIDs, names of digest algorithms
before a digest, and candidates that overlap a base span.

Positions are code points, ends exclusive. They come from splitting a text at
its matches: a match begins after all pieces and matches before it. Only texts
that hold a match at all are split.

Defined results: null counts as empty; a text without spans has empty strings;
repeated rows are each scanned alone; columns other than id and text are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{24,}"
ALLOWED = (
    "^[A-Za-z_=/+-]*[0-9]{0,2}[A-Za-z_=/+-]*$",
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "^(?i:md5|sha1|sha256|sha384|sha512)[-=]",
)
#: Bits for each character that a window must reach, by class.
THRESHOLDS = {"hex": 3.0, "base36": 3.6, "base64": 3.9}
KINDS = ("assign", "access", "hex", "entropy")
SPAN = "array<struct<start:int,kind:int,stop:int>>"


def matches(text: Column, pattern: str, kind: int, least: int = 0, group: int = 0) -> Column:
    """The spans of a pattern's matches whose group has ``least`` characters or more."""
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(pieces.alias("piece"), whole.alias("whole"), value.alias("value"))

    def step(done: Column, part: Column) -> Column:
        begin = done["at"] + F.length(part["piece"])
        end = begin + F.coalesce(F.length(part["whole"]), F.lit(0))
        found = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("stop"))
        good = F.coalesce(F.length(part["value"]) >= max(1, least), F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.concat(done["spans"], F.array(found))).otherwise(done["spans"]).alias("spans"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
    return F.aggregate(parts, first, step, lambda done: done["spans"])


def _bits(count: Column) -> Column:
    """n log2 n, the term that a character's count adds."""
    return F.when(count > 1, count * F.log2(count)).otherwise(F.lit(0.0))


def top_entropy(text: Column, width: int) -> Column:
    """The highest Shannon entropy of a window of ``width`` characters, by counts updated one character in, one out."""
    chars = F.split(text, "")

    def step(done: Column, at: Column) -> Column:
        into, out = F.element_at(chars, at), F.when(at > width, F.get(chars, at - width - 1))
        had = F.coalesce(F.element_at(done["counts"], into), F.lit(0))
        plus = F.map_concat(F.map_filter(done["counts"], lambda k, _: k != into), F.create_map(into, had + 1))
        sums = done["sums"] + _bits(had + 1) - _bits(had)
        held = F.coalesce(F.element_at(plus, out), F.lit(0))
        counts = F.when(out.isNull(), plus).otherwise(F.transform_values(plus, lambda k, v: F.when(k == out, v - 1).otherwise(v)))
        sums = F.when(out.isNull(), sums).otherwise(sums + _bits(held - 1) - _bits(held))
        entropy = F.log2(F.lit(float(width))) - sums / width
        top = F.when(at >= width, F.greatest(done["top"], entropy)).otherwise(done["top"])
        return F.struct(counts.alias("counts"), sums.alias("sums"), top.alias("top"))

    first = F.struct(F.create_map().cast("map<string,int>").alias("counts"), F.lit(0.0).alias("sums"), F.lit(0.0).alias("top"))
    return F.aggregate(F.sequence(F.lit(1), F.length(text)), first, step, lambda done: done["top"])


def _entropy_spans(text: Column, base: Column, width: int) -> Column:
    spans = matches(text, CANDIDATE, 3)

    def wanted(span: Column) -> Column:
        word = F.substring(text, span["start"] + 1, span["stop"] - span["start"])
        kind = (
            F.when(word.rlike("^[0-9A-Fa-f]+$"), THRESHOLDS["hex"])
            .when(word.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), THRESHOLDS["base36"])
            .otherwise(THRESHOLDS["base64"])
        )
        clear = ~F.exists(base, lambda b: (b["start"] < span["stop"]) & (span["start"] < b["stop"]))
        for allowed in ALLOWED:
            clear = clear & ~word.rlike(allowed)
        return F.when(clear, top_entropy(word, width) >= kind).otherwise(F.lit(False))

    return F.filter(spans, wanted)


def _written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def secret_scan(docs: DataFrame, width: int = 20) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans (``kind:start:end``, joined)."""
    none = F.array().cast(SPAN)
    text = F.col("text")
    found = lambda pattern, *rest: F.when(text.rlike(pattern), matches(text, pattern, *rest)).otherwise(none)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", found(ASSIGN, 0, 6, 1).alias("a"), found(ACCESS, 1).alias("k"), found(HEX, 2).alias("h"))
    rows = rows.withColumn("base", F.concat("a", "k", "h"))
    maybe = F.when(text.rlike(CANDIDATE), _entropy_spans(text, F.col("base"), width)).otherwise(none)
    rows = rows.withColumn("e", maybe)
    return rows.select(
        "doc_id",
        *(F.size(c).cast("long").alias(f"n_{n}") for c, n in zip("akhe", KINDS, strict=True)),
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.concat("base", "e")).alias("spans"),
    )
