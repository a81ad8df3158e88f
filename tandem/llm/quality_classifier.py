"""Quality classifier: ordinal cumulative-link regression on graded ratings.

``P(grade <= k) = sigmoid(t[k] - w.x)`` with one weight vector for all grades
and ordered thresholds. x says which hashed tokens a text has, in ``2**bits``
buckets: its words (``[0-9a-z]`` and non-ASCII bytes, A-Z in lower case), its
runs of other visible characters, and three tokens of shape (the class of its
number of words, of its share of words that repeat the word before, and of its
symbols for each word). The model gives a text's expected grade and
its tail probability ``P(grade >= k)``, which selection compares with a
probability.

It is fitted on a sample of at most about ``sample_rows`` labelled rows, chosen by
a hash of the id: the sample's tokens come to the driver as bucket numbers, and
full-batch steps (Adam) fit weights and thresholds there. A bucket held by
fewer than ``least_docs`` sampled rows has no weight. All documents are scored,
in blocks, in one pass without a shuffle.

Defined results: a null or empty text has no tokens and gets the prior's
grades; several ratings of one id all count; ratings that are null, or whose
text is null, are not learned from; with no ratings every expected grade is
null and every row is kept; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm.hashing import LOWER, NON_ALNUM, cut, distinct, mix, owners, text_blocks, word_hashes

#: Bytes between runs of visible characters that are in no word.
NON_SYMBOL = ~NON_ALNUM
NON_SYMBOL[:0x21] = True
NON_SYMBOL[0x7F] = True
#: Bytes of text taken at once: two passes over the tokens hold many times that.
BLOCK = 1 << 19
#: Bounds between the classes of a share.
SHARES = (0.001, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8)


def tokens(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The text and the bucket of each token of a block."""
    data, n = LOWER[data], len(offsets) - 1
    docs, hashes = [], []
    for between in (NON_ALNUM, NON_SYMBOL):
        starts, ends, first = cut(data, offsets, between)
        docs.append(owners(first))
        hashes.append(word_hashes(data, starts, ends))
    words, again = np.bincount(docs[0], minlength=n), np.zeros(n, np.int64)
    if len(hashes[0]):
        again = np.bincount(docs[0][1:], (hashes[0][1:] == hashes[0][:-1]) & (docs[0][1:] == docs[0][:-1]), n)
    symbols = np.bincount(docs[1], minlength=n)
    shape = (np.log2(words + 1).astype(np.int64), 100 + np.digitize(again / np.maximum(words, 1), SHARES), 200 + np.digitize(symbols / np.maximum(words, 1), SHARES))
    for kind in shape:
        docs.append(np.arange(n))
        hashes.append(mix(kind.astype(np.uint64) + np.uint64(1)))
    return np.concatenate(docs), (np.concatenate(hashes) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    grades: np.ndarray
    """the ratings learned, in order"""
    thresholds: np.ndarray
    weights: np.ndarray
    bits: int

    def tails(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each text and each k from the second grade on."""
        doc, bucket = tokens(data, offsets, self.bits)
        heavy = self.weights[bucket] != 0
        pairs = distinct((doc[heavy] << self.bits) | bucket[heavy])
        score = np.bincount(pairs >> self.bits, self.weights[pairs & ((1 << self.bits) - 1)], len(offsets) - 1)
        return _sigmoid(score[:, None] - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def cumulative_link(
    doc: np.ndarray, column: np.ndarray, grade: np.ndarray, n_columns: int, n_grades: int, steps: int = 250, rate: float = 0.1, l2: float = 1e-4
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds for rows given as (doc, column) pairs sorted by doc and grades 0 to n_grades - 1."""
    n = len(grade)
    w = np.zeros(n_columns)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=n_grades))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])  # first threshold, logs of the gaps
    moments = [np.zeros(n_columns + n_grades - 1) for _ in range(2)]
    by_column = np.argsort(column, kind="stable")
    doc_by_column, edges = doc[by_column], np.searchsorted(column[by_column], np.arange(n_columns))
    full = np.bincount(column, minlength=n_columns) > 0
    for step in range(1, steps + 1):
        t = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        score = np.bincount(doc, w[column], n)
        cdf = _sigmoid(np.concatenate([[-np.inf], t, [np.inf]])[None, :] - score[:, None])
        at = np.arange(n)
        high, low = cdf[at, grade + 1], cdf[at, grade]
        mass = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / mass, low * (1 - low) / mass
        to_score = (d_high - d_low) / n  # of the negative log-likelihood
        to_t = (np.bincount(grade, d_low, n_grades + 1)[1:n_grades] - np.bincount(grade, d_high, n_grades)[: n_grades - 1]) / n
        to_w = np.zeros(n_columns)
        if len(column):
            to_w[full] = np.add.reduceat(to_score[doc_by_column], edges[full])
        tail = np.cumsum(to_t[::-1])[::-1]
        gradient = np.concatenate([to_w + l2 * w, tail[:1], tail[1:] * np.exp(free[1:])])
        moments[0] += 0.1 * (gradient - moments[0])
        moments[1] += 0.01 * (gradient**2 - moments[1])
        move = rate * (1 - step / (steps + 1)) * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w -= move[:n_columns]
        free -= move[n_columns:]
    return w, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def fit(rated: DataFrame, sample_rows: int = 20_000, bits: int = 20, least_docs: int = 10) -> Model:
    """Learn from (doc_id, text, rating) rows with integer ratings; sample_rows bounds the sample."""
    rated = rated.filter("rating IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("rating").cast("int").alias("rating")
    )
    total = rated.count()
    chosen = rated.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < min(1.0, sample_rows / max(1, total)) * (1 << 20))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, "text", BLOCK):
            doc, bucket = tokens(data, offsets, bits)
            pairs = distinct((doc << bits) | bucket)
            ends = np.searchsorted(pairs >> bits, np.arange(rows.num_rows + 1)).tolist()
            held = (pairs & ((1 << bits) - 1)).astype(np.int32)
            out = [held[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("rating"), pa.array(out, pa.binary())], names=["doc_id", "rating", "buckets"])

    rows = chosen.mapInArrow(read, "doc_id long, rating int, buckets binary").toLocalIterator()
    rows = sorted(((r.doc_id, r.rating, bytes(r.buckets)) for r in rows), key=lambda r: (r[0] is None, r))
    weights = np.zeros(1 << bits, np.float32)
    if not rows:
        return Model(np.zeros(0, np.int64), np.zeros(0), weights, bits)
    grades, grade = np.unique([r[1] for r in rows], return_inverse=True)
    bucket = np.concatenate([np.frombuffer(r[2], np.int32) for r in rows])
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[2]) // 4 for r in rows])
    common = np.bincount(bucket, minlength=1 << bits) >= least_docs
    good = common[bucket]
    columns = np.flatnonzero(common)
    w, thresholds = cumulative_link(doc[good], np.searchsorted(columns, bucket[good]).astype(np.int32), grade, len(columns), len(grades))
    weights[columns] = w
    return Model(grades, thresholds, weights, bits)


def graded(docs: DataFrame, model: Model, least: int, keep_at: float = 0.5) -> DataFrame:
    """docs with expected_grade, tail (P(grade >= least)) and keep (tail >= keep_at); needs columns doc_id and text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    names = [*docs.columns, "expected_grade", "tail", "keep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for rows, data, offsets in text_blocks(batches, "text", BLOCK):
            n = rows.num_rows
            if len(known.grades):
                tails = np.concatenate([np.ones((n, 1)), known.tails(data, offsets)], 1)
                steps = np.diff(known.grades, prepend=0)
                expected = pa.array(tails @ steps)
                above = known.grades >= least
                tail = tails[:, above.argmax()] if above.any() else np.zeros(n)
            else:
                expected, tail = pa.nulls(n, pa.float64()), np.ones(n)
            yield pa.RecordBatch.from_arrays([*rows.columns, expected, pa.array(tail), pa.array(tail >= keep_at)], names=names)

    extra = "expected_grade double, tail double, keep boolean"
    return docs.mapInArrow(run, T.StructType([*docs.schema, *T.StructType.fromDDL(extra)]))
