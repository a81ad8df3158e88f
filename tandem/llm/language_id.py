"""Language identification of mixed-language text: script ranges, word scores, Viterbi.

Words are maximal runs of letters of one script (Unicode ranges below). A
word's score for a language is the sum of log-probability ratios of its
character 1-, 2- and 3-grams (with word bounds, in lower case) under that
language's smoothed counts, kept in a table of ``2**bits`` buckets. A language
is a candidate for a word only if it wrote at least ``script_share`` of its
training letters in the word's script. Viterbi over the words of a text, with
a ``switch`` penalty for each change of language, labels each word; the spans of
equal labels are the text's languages. The language with most letters is the
prediction; its score is its share of the letters.

Training reads a sample of at most about ``per_language`` labelled texts of each
language, chosen by a hash of the id with a rate set from the language's count,
so a language of any size gives a bounded sample; all other texts are only
predicted.

Scoring works on blocks of texts: gram buckets, sums by word and the Viterbi
recursion run as numpy operations over all texts of a block at once, a step for
each word position.

Defined results: ``und`` with score 0 for a null text, a text without a letter
or when nothing was learned; a word whose script no language writes has all
languages as candidates; repeated rows get equal results; columns other than
id, text and (for training) lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First and last code point of the letters of each script.
SCRIPTS = (
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x0400, 0x052F),
    ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x06FF), ("Arabic", 0x0750, 0x077F), ("Devanagari", 0x0900, 0x097F),
    ("Bengali", 0x0980, 0x09FF), ("Gurmukhi", 0x0A00, 0x0A7F), ("Gujarati", 0x0A80, 0x0AFF), ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F),
    ("Kannada", 0x0C80, 0x0CFF), ("Malayalam", 0x0D00, 0x0D7F), ("Sinhala", 0x0D80, 0x0DFF), ("Thai", 0x0E00, 0x0E7F), ("Lao", 0x0E80, 0x0EFF),
    ("Tibetan", 0x0F00, 0x0FFF), ("Burmese", 0x1000, 0x109F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Hangul", 0xAC00, 0xD7AF),
    ("Ethiopic", 0x1200, 0x137F), ("Khmer", 0x1780, 0x17FF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Han", 0x20000, 0x3134F),
)
NAMES = [*dict.fromkeys(name for name, _, _ in SCRIPTS), "Other"]
BLOCK_CHARS = 1 << 20

_scripts: list[np.ndarray] = []


def script_table() -> np.ndarray:
    """For each code point 0 if it isn't a letter, else 1 + the number of its script."""
    if not _scripts:
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        table = np.where(letter, len(NAMES), 0).astype(np.uint8)
        for name, low, high in SCRIPTS:
            table[low : high + 1][letter[low : high + 1]] = NAMES.index(name) + 1
        _scripts.append(table)
    return _scripts[0]


def blocks(texts: pa.Array, most: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``most`` characters (one text at least), with the row of the first."""
    held, size, begin = [], 0, 0
    for row, text in enumerate(texts):
        text = text.as_py() or ""
        if held and size + len(text) > most:
            yield begin, held
            held, size, begin = [], 0, row
        held.append(text)
        size += len(text)
    if held:
        yield begin, held


@dataclass
class Words:
    """The words of a block: gram buckets and the word each belongs to, script, letters and text of each word."""

    gram: np.ndarray
    gram_word: np.ndarray
    script: np.ndarray
    letters: np.ndarray
    text: np.ndarray


def words_of(texts: list[str], bits: int) -> Words:
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    script = script_table()[np.minimum(points, 0x10FFFF)]
    sizes = np.array([len(t) + 1 for t in lowered])
    new = np.ones(len(points), bool)
    new[1:] = script[1:] != script[:-1]
    starts = np.flatnonzero(new & (script > 0))
    ends = np.flatnonzero(np.append(new[1:], True)[: len(points)] & (script > 0)) + 1
    size = ends - starts
    # each word with a bound before and behind: 0 for not a letter, so the points around serve
    bounded = np.zeros(len(points) + 2, np.uint64)
    bounded[1:-1] = np.where(script > 0, points, 0)
    word = np.repeat(np.arange(len(starts)), size)
    at = np.arange(size.sum()) + np.repeat(starts - (np.cumsum(size) - size), size) + 1
    before = np.where(at - 1 == starts[word], 0, bounded[at - 1])
    behind = np.where(at == ends[word], 0, bounded[at + 1])
    here = bounded[at]
    mult = np.uint64(0x9E3779B97F4A7C15)
    grams = [here * mult, (before * np.uint64(0x110001) + here) * mult + np.uint64(1 << 60), ((before << np.uint64(42)) + (here << np.uint64(21)) + behind) * mult]
    top = np.uint64(64 - bits)
    buckets = np.concatenate([(g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> top for g in grams]).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)[starts] if len(starts) else np.zeros(0, np.int64)
    return Words(buckets, np.concatenate([word] * 3), script[starts] - 1, size, text)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    """float32, buckets x languages: log probability less the mean over the languages"""
    candidate: np.ndarray
    """bool, scripts x languages"""
    bits: int
    switch: float

    def spans(self, texts: list[str]) -> tuple[Words, np.ndarray]:
        """The words of some texts and the language of each (Viterbi)."""
        words = words_of(texts, self.bits)
        n, k = len(words.script), len(self.languages)
        if not n or not k:
            return words, np.zeros(n, np.int64)
        score = np.stack([np.bincount(words.gram_word, self.weights[:, j][words.gram], n) for j in range(k)], 1)
        score[~self.candidate[words.script]] -= 1e4
        count = np.bincount(words.text, minlength=len(texts))
        first = np.cumsum(count) - count
        order = np.argsort(-count, kind="stable")
        best = np.zeros((len(texts), k))
        came = np.zeros((n, k), np.int8 if k < 128 else np.int16)
        alive = int((count > 0).sum())
        longest = count[order]
        for t in range(int(count.max())):
            while longest[alive - 1] <= t:
                alive -= 1
            rows = order[:alive]
            had = best[rows]
            top = had.argmax(1)
            jump = had[np.arange(alive), top] - self.switch
            stay = had >= jump[:, None]
            came[first[rows] + t] = np.where(stay, np.arange(k), top[:, None])
            best[rows] = np.where(stay, had, jump[:, None]) + score[first[rows] + t]
        label = np.zeros(n, np.int64)
        alive, now = 0, best.argmax(1)
        for t in range(int(count.max()) - 1, -1, -1):
            while alive < len(order) and longest[alive] > t:
                alive += 1
            rows = order[:alive]
            at = first[rows] + t
            label[at] = now[rows]
            now[rows] = came[at, now[rows]]
        return words, label

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        words, label = self.spans(texts)
        k = len(self.languages)
        if not k:
            return ["und"] * len(texts), [0.0] * len(texts)
        letters = np.bincount(words.text * k + label, words.letters, len(texts) * k).reshape(-1, k)
        total, top = letters.sum(1), letters.argmax(1)
        share = letters.max(1) / np.maximum(total, 1)
        names = [self.languages[j] if n else "und" for j, n in zip(top, total, strict=True)]
        return names, np.where(total > 0, share, 0.0).tolist()


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def fit(labelled: DataFrame, per_language: int = 3000, bits: int = 16, script_share: float = 0.01, switch: float = 8.0) -> Model:
    """Learn from (doc_id, text, lang) rows; the sample's bound is per_language, the model's 2**bits buckets a language."""
    known = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    none = Model(languages, np.zeros((1 << bits, len(languages)), np.float32), np.ones((len(NAMES), len(languages)), bool), bits, switch)
    if not languages:
        return none
    rate = F.lit(0.0)
    for name in languages:
        rate = F.when(F.col("lang") == name, F.lit(min(1.0, per_language / counts[name]))).otherwise(rate)
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate * (1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(languages), 1 << bits), np.int64)
        scripts = np.zeros((len(languages), len(NAMES)), np.int64)
        for batch in batches:
            lang = np.array([languages.index(x) for x in batch.column("lang").to_pylist()], np.int64)
            for begin, texts in blocks(batch.column("text")):
                words = words_of(texts, bits)
                own = lang[begin + words.text]
                grams += np.bincount(own[words.gram_word] * (1 << bits) + words.gram, minlength=grams.size).reshape(grams.shape)
                scripts += np.bincount(own * len(NAMES) + words.script, words.letters, scripts.size).astype(np.int64).reshape(scripts.shape)
        for j in range(len(languages)):
            at = np.flatnonzero(grams[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), j)), pa.array(at), pa.array(grams[j, at])], names=["lang", "bucket", "n"])
            at = np.flatnonzero(scripts[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), j)), pa.array(-1 - at), pa.array(scripts[j, at])], names=["lang", "bucket", "n"])

    found = known.filter(chosen).select("text", "lang").mapInArrow(count, "lang long, bucket long, n long")
    total = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    grams, scripts = np.zeros((1 << bits, len(languages))), np.zeros((len(NAMES), len(languages)))
    is_gram = (total["bucket"] >= 0).to_numpy()
    lang, bucket, n = (total[c].to_numpy() for c in ("lang", "bucket", "n"))
    grams[bucket[is_gram], lang[is_gram]] = n[is_gram]
    scripts[-1 - bucket[~is_gram], lang[~is_gram]] = n[~is_gram]
    logs = np.log(grams + 0.5) - np.log(grams.sum(0) + 0.5 * len(grams))
    weights = (logs - logs.mean(1, keepdims=True)).astype(np.float32)
    weights[grams.sum(1) == 0] = 0
    candidate = scripts >= script_share * np.maximum(scripts.sum(0), 1)
    candidate[~candidate.any(1)] = True
    return Model(languages, weights, candidate, bits, switch)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            names, scores = [], []
            for _, texts in blocks(batch.column("text")):
                n, s = known.predict(texts)
                names += n
                scores += s
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and spans: array of (lang, words, letters) in the order of the text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64()), ("letters", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            out: list[list[dict]] = []
            for _, texts in blocks(batch.column("text")):
                words, label = known.spans(texts)
                own: list[list[dict]] = [[] for _ in texts]
                for text, j, n in zip(words.text.tolist(), label.tolist(), words.letters.tolist(), strict=True):
                    if own[text] and own[text][-1]["lang"] == known.languages[j]:
                        own[text][-1]["words"] += 1
                        own[text][-1]["letters"] += n
                    elif known.languages:
                        own[text].append({"lang": known.languages[j], "words": 1, "letters": n})
                out += own
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<lang:string,words:long,letters:long>>")
