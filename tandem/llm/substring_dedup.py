"""Substring dedup by level-wise doubling.

Remove from each document the words covered by a window of ``min_words`` words
that also starts in a document with a smaller id.

Level 1 looks at windows of half that length, and only at the one that has the
smallest hash among the ``min_words - half + 1`` half-windows of a full window:
equal full windows choose equal half-windows, so nothing is lost and about one
position in thirteen is shuffled. Half-windows seen in one document alone are
out. Level 2 extends the surviving ones to twice their length, all the full
windows that chose them. No candidate then needs a further doubling: a longer
repeat is covered by its repeated full windows.

Between the levels the surviving hashes travel as a bitmap of fixed size
(``filter_bits``): a false positive only sends a window to level 2, where a
128-bit hash decides. Each task resolves the repeats that it sees itself and
sends only the windows of the smallest id that it has them from, so a passage
held by a third of all documents is a row for each block of text, not for each
document.

Defined results: a null or empty text has no words; repeats within one document
stay; rows with equal ids and texts get equal results, rows of one id with
different texts one each (neither removes from the other); a row with a null id is
returned with all its words and removes nothing elsewhere; columns other than
the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.hashing import BASES, SPACE, cut, owners, prefix_sums, span_hashes, text_blocks, word_hashes
from tandem.llm.storage import stored

LEVEL_1 = "hash long, low long, high long"
LEVEL_2 = "h1 long, h2 long, doc_id long, text_hash long, span long, covered boolean"


def _chosen(data: np.ndarray, offsets: np.ndarray, ids: pa.Array, min_words: int):
    """The full windows of a block: word prefix sums, starts, document row and the hash of the chosen half."""
    half = min_words // 2
    starts, ends, first = cut(data, offsets, SPACE)
    words = word_hashes(data, starts, ends)
    doc = owners(first)
    at = np.arange(max(0, len(words) - min_words + 1))
    known = np.asarray(ids.is_valid())
    at = at[(doc[at] == doc[at + min_words - 1]) & known[doc[at]]]
    if not len(at):
        return None
    sums = prefix_sums(words)
    begins = np.arange(len(words) - half + 1)
    halves = span_hashes(sums, begins, begins + half)
    views = np.lib.stride_tricks.sliding_window_view(halves, min_words - half + 1)
    return words, sums, at, doc[at], halves[at + views.argmin(axis=1)[at]], first


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together (the last key decides last), and where each run of the first begins."""
    order = np.lexsort(keys[::-1])
    return order, keys[0][order]


def level_1(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, "text"):
            found = _chosen(data, offsets, rows.column("doc_id"), min_words)
            if found is None:
                continue
            ids = rows.column("doc_id").fill_null(0).to_numpy()[found[3]]
            order, keys = _groups(found[4], ids)
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            end = np.append(begin[1:], len(keys)) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[begin].view(np.int64)), pa.array(ids[order][begin]), pa.array(ids[order][end])],
                names=["hash", "low", "high"],
            )

    return run


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits with the top bits of each hash set; its size does not depend on the rows."""
    parts = max(0, bits - 17)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            index = batch.column("index").to_numpy()
            for part in np.unique(index >> 17):
                mine = index[index >> 17 == part] & 0x1FFFF
                flags = held.setdefault(int(part), np.zeros(1 << 17, bool))
                flags[mine] = True
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int64()), pa.array([np.packbits(x).tobytes() for x in held.values()])],
                names=["part", "flags"],
            )

    index = hashes.select(F.shiftrightunsigned("hash", 64 - bits).alias("index")).distinct()
    out = np.zeros((1 << parts, 1 << 14), np.uint8)
    spread = index.repartition(F.shiftright("index", 17))
    for row in spread.mapInArrow(blocks, "part long, flags binary").collect():  # 2**bits bits in all
        out[row.part] |= np.frombuffer(row.flags, np.uint8)
    return out.reshape(-1)


def level_2(min_words: int, bits: int, flags):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = flags.value
        for rows, data, offsets in text_blocks(batches, "text", 1 << 22):
            found = _chosen(data, offsets, rows.column("doc_id"), min_words)
            if found is None:
                continue
            words, sums, at, doc, half, first = found
            index = (half >> np.uint64(64 - bits)).astype(np.int64)
            alive = (seen[index >> 3] >> (7 - (index & 7)).astype(np.uint8)) & 1 == 1
            at, doc = at[alive], doc[alive]
            if not len(at):
                continue
            ids = rows.column("doc_id").fill_null(0).to_numpy()[doc]
            h1 = span_hashes(sums, at, at + min_words)
            h2 = span_hashes(prefix_sums(words, BASES[1]), at, at + min_words, BASES[1])
            order, keys = _groups(h1, ids)
            fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
            lowest = ids[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            own, send = np.zeros(len(at), bool), np.zeros(len(at), bool)
            own[order] = ids[order] > lowest
            send[order] = ids[order] == lowest  # every place in the lowest document: it may hold a window twice
            # windows resolved here, as runs of consecutive starts
            here = np.flatnonzero(own)
            new = np.concatenate([[True], (np.diff(at[here]) != 1) | (np.diff(doc[here]) != 0)]) if len(here) else here
            begin, end = here[np.flatnonzero(new)], here[np.append(np.flatnonzero(new)[1:], len(here)) - 1] if len(here) else here
            sent = np.flatnonzero(send)
            both = np.concatenate([sent, begin])
            start = at[both] - first[doc[both]]
            stop = at[np.concatenate([sent, end])] - first[doc[both]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h1[both].view(np.int64)),
                    pa.array(np.concatenate([h2[sent].view(np.int64), ids[begin] * 1_000_003 + at[begin]])),
                    pa.array(ids[both]),
                    rows.column("text_hash").take(pa.array(doc[both])),
                    pa.array(start.astype(np.int64) << 32 | stop.astype(np.int64)),
                    pa.array(np.arange(len(both)) >= len(sent)),
                ],
                names=["h1", "h2", "doc_id", "text_hash", "span", "covered"],
            )

    return run


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def repeated_windows(docs: DataFrame, min_words: int = 50, filter_bits: int = 26) -> DataFrame:
    """doc_id, text_hash (xxhash64) and ``spans``: the runs of word positions where a window that a smaller id holds too begins, as start << 32 | stop."""
    if min_words < 2:
        raise ValueError("min_words must be 2 or more")
    spark = docs.sparkSession
    texts = _texts(docs)
    survivors = (
        texts.mapInArrow(level_1(min_words), LEVEL_1)
        .groupBy("hash")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .filter("low < high")
        .select("hash")
    )
    flags = spark.sparkContext.broadcast(bitmap(survivors, filter_bits))
    windows = texts.mapInArrow(level_2(min_words, filter_bits, flags), LEVEL_2)
    lowest = F.min("doc_id").over(Window.partitionBy("h1", "h2"))
    return (
        windows.withColumn("lowest", lowest)
        .filter("covered or lowest < doc_id")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list("span").alias("spans"))
    )


def _cleaned(min_words: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            out = []
            for text, spans in zip(texts, batch.column("spans"), strict=True):
                words = (text.as_py() or b"").split()
                n, spans = len(words), spans.values
                if spans is not None and len(spans):
                    spans = spans.to_numpy()
                    marks = np.zeros(n + 1, np.int64)
                    np.add.at(marks, spans >> 32, 1)
                    np.add.at(marks, (spans & 0xFFFFFFFF) + min_words, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0)]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            n_words, n_removed, digest, kept = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(digest, pa.string()),
                    *([pa.array(kept, pa.string())] if with_text else []),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])],
            )

    return run


def substring_dedup(docs: DataFrame, min_words: int = 50, filter_bits: int = 26, with_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and, if with_text, the kept words joined by spaces."""
    spans = stored(repeated_windows(docs, min_words, filter_bits), "repeats")
    texts = _texts(docs)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return texts.join(spans, ["doc_id", "text_hash"], "left").mapInArrow(_cleaned(min_words, with_text), schema)
