"""Benchmark decontamination with an FM-index for each shard of the training documents.

A phrase is a window of ``window`` consecutive words of a benchmark item (all
of its words if it has fewer); words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of
the text with A-Z in lower case. A document word inside any occurrence of a
phrase is hit.

Each task cuts its documents into shards of a few MB, with no shuffle. A
shard's words become numbers: those of the benchmark's vocabulary their own,
any other the separator, which no phrase holds; runs of vocabulary words too
short for any phrase are left out of the index for the same reason. Over the
rest it builds an FM-index, finds all phrases at once by backward search
through wavelet-tree ranks, locates the occurrences by sampled suffix positions
and merges them into spans.

The benchmark is sent to the tasks in blocks of at most ``block_words`` words,
so what is broadcast is bounded; if there are several blocks, the documents
pass through one round for each and carry their spans along.

Defined results: null and empty texts have no words and are clean; items
without words have no phrase; a null item_id counts as an empty string; repeated
rows are each judged alone; columns other than id and text pass unread.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm.fm_index import FMIndex
from tandem.llm.hashing import LOWER, NON_ALNUM, cut, owners, text_blocks, word_hashes
from tandem.llm.storage import stored

SHARD_BYTES = 1 << 21
#: A word before A-Z is put in lower case.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Phrases:
    """The windows of some benchmark items, as rows of word numbers; 0 stands for any word outside."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        data = LOWER[np.frombuffer(b"".join(t for _, t in items), np.uint8)]
        offsets = np.cumsum([0, *(len(t) for _, t in items)])
        starts, ends, first = cut(data, offsets, NON_ALNUM)
        hashes = word_hashes(data, starts, ends)
        self.vocabulary = np.unique(hashes)
        self.filter = np.zeros(1 << 16, bool)
        self.filter[self.vocabulary >> np.uint64(48)] = True
        ids = self.numbers(hashes)
        self.names = [n for n, _ in items]
        rows: dict[bytes, list[int]] = {}
        for item in range(len(items)):
            words = ids[first[item] : first[item + 1]]
            for at in range(max(min(len(words), 1), len(words) - window + 1)):
                held = rows.setdefault(words[at : at + window].tobytes(), [])
                if not held or held[-1] != item:
                    held.append(item)
        self.lengths = np.array([len(k) // 8 for k in rows], np.int64)
        self.patterns = np.zeros((len(rows), window), np.int64)
        for row, key in enumerate(rows):
            self.patterns[row, window - len(key) // 8 :] = np.frombuffer(key, np.int64)
        self.begin = np.cumsum([0, *map(len, rows.values())])
        self.items = np.array([i for held in rows.values() for i in held], np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.filter[hashes >> np.uint64(48)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == hashes[maybe]
        out[maybe[same]] = at[same] + 1
        return out

    def occurrences(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first word and the phrase of each occurrence in a shard."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.patterns) or not len(hashes):
            return none
        ids = self.numbers(hashes)
        live = ids > 0
        new = np.ones(len(ids), bool)
        new[1:] = (live[1:] != live[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(ids)))
        good = live[begin] & (size >= self.lengths.min())
        begin, size = begin[good], size[good]
        if not len(begin):
            return none
        # the kept runs, each followed by a separator
        to = np.cumsum(size + 1)
        word = np.arange(to[-1]) - np.repeat(to - size - 1 - begin, size + 1)
        symbols = np.zeros(to[-1], np.int64)
        inside = np.ones(to[-1], bool)
        inside[to - 1] = False
        symbols[inside] = ids[word[inside]]
        index = FMIndex(symbols, len(self.vocabulary) + 1)
        low, high = index.search(self.patterns, self.lengths)
        count = np.maximum(high - low, 0)
        phrase = np.repeat(np.arange(len(count)), count)
        rows = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count - low, count)
        return word[index.locate(rows)], phrase


def _find(phrases, carried: bool, finish):
    """Spans (word positions in the text, merged) and items of each document; finish makes the columns that leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = phrases.value
        for rows, data, offsets in text_blocks(batches, "text", SHARD_BYTES):
            data = LOWER[data]
            starts, ends, first = cut(data, offsets, NON_ALNUM)
            doc = owners(first)
            at, phrase = known.occurrences(word_hashes(data, starts, ends), doc)
            marks = np.zeros(len(starts) + 1, np.int64)
            np.add.at(marks, at, 1)
            np.add.at(marks, at + known.lengths[phrase], -1)
            hit = np.cumsum(marks[:-1]) > 0
            count = known.begin[phrase + 1] - known.begin[phrase]
            which = known.items[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - known.begin[phrase], count)]
            pairs = np.unique(np.stack([np.repeat(doc[at], count), which]), axis=1)
            items: dict[int, set[str]] = {}
            for d, i in pairs.T.tolist():
                items.setdefault(d, set()).add(known.names[i])
            if carried:
                for d, (spans, names) in enumerate(zip(rows.column("_spans").to_pylist(), rows.column("_items").to_pylist(), strict=True)):
                    for a, b in zip(spans[::2], spans[1::2], strict=True):
                        hit[first[d] + a : first[d] + b] = True
                    if names:
                        items.setdefault(d, set()).update(names)
            # merged runs of hit words, never across documents
            new = np.ones(len(hit), bool)
            new[1:] = (hit[1:] != hit[:-1]) | (doc[1:] != doc[:-1])
            begin = np.flatnonzero(new & hit)
            last = np.flatnonzero(np.append(new[1:], True)[: len(hit)] & hit) + 1
            spans: list[list[int]] = [[] for _ in range(rows.num_rows)]
            for d, a, b in zip(doc[begin].tolist(), begin.tolist(), last.tolist(), strict=True):
                spans[d] += [a - int(first[d]), b - int(first[d])]
            yield finish(rows, spans, [sorted(items.get(d, ())) for d in range(rows.num_rows)], offsets, starts, ends, first)

    return run


def _carry(rows, spans, items, *_):
    kept = [n for n in rows.schema.names if n not in ("_spans", "_items")]
    return pa.RecordBatch.from_arrays(
        [*(rows.column(n) for n in kept), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
        names=[*kept, "_spans", "_items"],
    )


def _report(rows, spans, items, offsets, starts, ends, first):
    hits = [sum(s[1::2]) - sum(s[::2]) for s in spans]
    return pa.RecordBatch.from_arrays(
        [
            rows.column("doc_id"),
            pa.array(np.diff(first), pa.int64()),
            pa.array(hits, pa.int64()),
            pa.array([len(i) for i in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
            pa.array([h > 0 for h in hits], pa.bool_()),
            pa.array(items, pa.list_(pa.string())),
            pa.array(spans, pa.list_(pa.int64())),
        ],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
    )


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<long>"


def _clean(rows, spans, items, offsets, starts, ends, first):
    texts = rows.column("text").to_pylist()
    for d, own in enumerate(spans):
        if own:
            raw, out, at = texts[d].encode(), [], 0
            for a, b in zip(own[::2], own[1::2], strict=True):
                out.append(raw[at : int(starts[first[d] + a] - offsets[d])])
                at = int(ends[first[d] + b - 1] - offsets[d])
            texts[d] = b"".join([*out, raw[at:]]).decode()
    kept = [n for n in rows.schema.names if n not in ("_spans", "_items")]
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else rows.column(n) for n in kept], names=kept)


def phrase_blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Phrases]:
    """The benchmark's phrases in blocks of at most block_words words (one item at least)."""
    items, words = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    for name, text in rows.toLocalIterator():
        n = len(WORD.findall(text))
        if items and words + n > block_words:
            yield Phrases(items, window)
            items, words = [], 0
        items.append((name, text.encode()))
        words += n
    yield Phrases(items, window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 500_000, clean: bool = False) -> DataFrame:
    """A report for each document (REPORT), or with clean=True the documents themselves with the spans cut from their texts."""
    if window < 1:
        raise ValueError("window must be 1 or more")
    context = docs.sparkSession.sparkContext
    rows = docs.withColumn("text", F.col("text").cast("string"))
    if not clean:
        rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema, waiting, carried = rows.schema, None, False
    carry = T.StructType([*schema, T.StructField("_spans", T.ArrayType(T.LongType())), T.StructField("_items", T.ArrayType(T.StringType()))])
    for block in phrase_blocks(benchmark, window, block_words):
        if waiting is not None:
            rows = stored(rows.mapInArrow(_find(context.broadcast(waiting), carried, _carry), carry), "spans")
            carried = True
        waiting = block
    return rows.mapInArrow(_find(context.broadcast(waiting), carried, _clean if clean else _report), schema if clean else REPORT)
