"""Fuzzy line dedup by MinHash.

Lines are the parts of a text between ``\\n``; a line without a visible character
is never a duplicate. Two lines are linked when the Jaccard similarity of their
sets of shingles is ``least`` or more; a shingle is the eight UTF-8 bytes from a
character on (a shorter line is one shingle). Of each connected component of lines, equal lines included, the first
occurrence (smallest doc_id, then line number) stays.

1. Each line gets a 64-bit hash (equal lines share it from here on) and a key for
   each of ``bands`` bands of ``rows`` minima: of one permutation in 256 bins, with
   empty bins filled from the next one, or, for lines that fill half of the bins
   or less, of real permutations. So a pair at similarity 0.8 shares one of 12
   bands of 5 with probability 0.99 at every length.
2. Band keys that two different lines have are found shard by shard and kept as
   a bitmap of fixed size; only lines that hit it are shuffled to their buckets.
3. The lines of a bucket go there once, with their texts, and are compared on
   their exact shingle sets (see buckets.py: nothing that could be linked is
   passed over, and no pair is emitted that isn't linked). ``early`` of ``bands`` band
   keys come first and join most of what is linked; of the others only buckets
   with lines of different groups are compared. Buckets of more than
   ``share`` lines are dealt out in parts first, whose linked lines become groups;
   then lines of different groups meet in cells.
4. Union-find joins the links to components.

Defined results: null and empty texts have one empty line, which stays;
repeated rows of one id and text are one document (the lines of each are the same
lines); rows of one id with different texts are documents of their own, in the
order of a hash of the text; a row with a null id keeps all its lines. Columns
other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.buckets import cells, compared, joined, labelled, mixed, parts
from tandem.llm.hashing import LINE_END, SPACE, cut, distinct, mix, owners, prefix_sums, span_hashes, text_blocks
from tandem.llm.storage import stored
from tandem.llm.substring_dedup import bitmap

U64 = np.uint64
#: Bytes of a shingle, bins of a signature.
WIDTH, BINS = 8, 256
#: Lines that fill at most SHORT bins have bands of real permutations, those of LONG or more have bands of bins. Lines
#: between have both: a pair at similarity 0.8 differs by a quarter of the smaller line, so it has one kind in common.
SHORT, LONG = 128, 90


def _hit(flags: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    index = (hashes.view(U64) >> U64(64 - bits)).astype(np.int64)
    return (flags[index >> 3] >> (7 - (index & 7)).astype(np.uint8)) & 1 == 1


class Lines:
    """The visible lines of a block of texts: document row, line number, hash and shingles."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        starts, ends, first = cut(data, offsets, LINE_END)
        breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
        doc = owners(first)
        seen = np.concatenate([[0], np.cumsum(~SPACE[data])])
        good = seen[ends] > seen[starts]
        self.starts, self.ends, self.doc = starts[good], ends[good], doc[good]
        self.number = breaks[self.starts] - breaks[offsets[self.doc]]
        self.sums = prefix_sums(data.astype(U64) + U64(1))
        self.hash = span_hashes(self.sums, self.starts, self.ends)

    def shingles(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of some lines and where each line's begin; not yet distinct."""
        return shingles(self.data, self.starts[which], self.ends[which])


def shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the WIDTH bytes from each character on of some spans, and where each span's begin.

    Eight bytes are one unaligned word, so no sums are needed. A span without
    room for one is one shingle of its own bytes.
    """
    padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    words = np.ndarray((len(data) + 1,), U64, padded.data, 0, (1,))
    room = np.maximum(ends - starts - WIDTH + 1, 1)
    at = np.arange(room.sum()) + np.repeat(starts - (np.cumsum(room) - room), room)
    span = np.repeat(np.arange(len(starts)), room)
    begins = (padded[at] & 0xC0) != 0x80  # a shingle begins with a character
    at, span = at[begins], span[begins]
    value = words[at]
    short = np.flatnonzero(ends - starts < WIDTH)
    if len(short):
        rows = np.searchsorted(span, short)
        value[rows] &= (U64(1) << (8 * (ends - starts)[short]).astype(U64)) - U64(1)
    value *= U64(0x9E3779B97F4A7C15)
    value ^= value >> U64(32)
    value *= U64(0xD6E8FEB86659FD93)
    return value, np.searchsorted(span, np.arange(len(starts) + 1))


def signatures(tokens: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (lines x bands) and filled bins from the minima in BINS bins."""
    n = len(begin) - 1
    line = np.repeat(np.arange(n) * BINS, np.diff(begin))
    low = np.full(n * BINS, 0xFFFFFFFF, np.uint32)
    line += (tokens >> U64(64 - BINS.bit_length() + 1)).astype(np.int64)
    np.minimum.at(low, line, (tokens >> U64(16)).astype(np.uint32))
    low = low.reshape(n, BINS)
    empty = low == 0xFFFFFFFF
    # an empty bin takes the next filled one to the right, round the end, with the distance
    at = np.where(empty, np.int16(4 * BINS), np.arange(BINS, dtype=np.int16))
    at = np.concatenate([at, at + np.int16(BINS)], 1)
    at = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :BINS]
    away = (at - np.arange(BINS, dtype=np.int16)).astype(np.uint32)
    value = np.take_along_axis(low, (at % BINS).astype(np.int64), 1) + away * np.uint32(0x9E3779B1)
    # the bins of a band are spread over the signature
    step = BINS // (bands * rows)
    taken = value[:, : step * bands * rows : step].reshape(n, rows, bands).astype(U64)
    keys = np.repeat(np.arange(bands, dtype=U64)[None, :], n, 0)
    for r in range(rows):
        keys = mix(keys * U64(0x9E3779B97F4A7C15) + taken[:, r, :] + U64(1))
    return keys, BINS - empty.sum(1)


def short_keys(tokens: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys (lines x bands) from the minima of bands * rows permutations of the shingles."""
    n = len(begin) - 1
    keys = np.repeat(np.arange(bands, dtype=U64)[None, :] + U64(1 << 32), n, 0)  # not those of bins
    if not n:
        return keys
    half = (tokens >> U64(32)).astype(np.uint32)
    factors = (mix(np.arange(1, bands * rows + 1, dtype=U64)).astype(np.uint32) | np.uint32(1)).reshape(bands, rows)
    for band in range(bands):
        for factor in factors[band]:
            turned = half * factor
            turned ^= turned >> np.uint32(15)
            turned *= np.uint32(0x2C1B3C6D)
            low = np.minimum.reduceat(turned, begin[:-1])
            keys[:, band] = mix(keys[:, band] * U64(0x9E3779B97F4A7C15) + low.astype(U64) + U64(1))
    return keys


def band_keys(tokens: np.ndarray, begin: np.ndarray, filled: np.ndarray, keys: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The band keys of all lines in a row, of one kind or both, and where each line's begin; keys are those of bins."""
    bands = keys.shape[1]
    short = np.flatnonzero(filled <= SHORT)
    size = np.diff(begin)
    own = np.repeat(filled <= SHORT, size)
    both = np.concatenate([keys, np.zeros_like(keys)], 1)
    both[short, bands:] = short_keys(tokens[own], np.concatenate([[0], np.cumsum(size[short])]), bands, rows)
    used = np.repeat(np.stack([filled >= LONG, filled <= SHORT], 1), bands, 1)
    return both[used], np.concatenate([[0], np.cumsum(used.sum(1))])


LINES = "doc_id long, text_hash long, line int, hash long, bands array<long>"


def _read(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in text_blocks(batches, "text", 1 << 20):
            lines = Lines(data, offsets)
            n = len(lines.hash)
            if not n:
                continue
            which = np.unique(lines.hash, return_index=True)[1]
            tokens, begin = lines.shingles(which)
            keys, filled = signatures(tokens, begin, bands, rows)
            keys, edge = band_keys(tokens, begin, filled, keys, rows)
            count = np.zeros(n, np.int64)
            count[which] = np.diff(edge)
            ends = np.zeros(n + 1, np.int32)
            np.cumsum(count, out=ends[1:])
            place = np.zeros(n, np.int64)
            place[which] = edge[:-1]
            at = np.arange(ends[-1]) + np.repeat(place - ends[:-1], count)
            doc = pa.array(lines.doc)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id").take(doc), block.column("text_hash").take(doc), pa.array(lines.number.astype(np.int32)),
                    pa.array(lines.hash.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[at].view(np.int64))),
                ],
                names=["doc_id", "text_hash", "line", "hash", "bands"],
            )

    return run


def _wanted(bits: int, flags):
    """The band keys of a line that the bitmap holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = flags.value
        for batch in batches:
            bands = batch.column("bands")
            keys = bands.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(bands.offsets.to_numpy()))
            good = _hit(seen, keys, bits)
            yield pa.RecordBatch.from_arrays([pa.array(keys[good]), batch.column("hash").take(pa.array(row[good]))], names=["bucket", "item"])

    return run


def _keys(shards: int):
    """Band keys of lines as blobs by shard: key, lower half of the line's hash."""
    shift = U64(64 - shards.bit_length() + 1)

    def out(keys, lines):
        order = np.argsort(keys)
        keys, lines = keys[order], lines[order]
        edges = np.searchsorted(keys >> shift, np.arange(shards + 1, dtype=U64))
        live = np.flatnonzero(np.diff(edges))
        parts = [pa.array([x[edges[s] : edges[s + 1]].tobytes() for s in live], pa.binary()) for x in (keys, lines)]
        return pa.RecordBatch.from_arrays([pa.array(live, pa.int64()), *parts], names=["shard", "keys", "lines"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            bands = batch.column("bands")
            own = bands.flatten().to_numpy().view(U64)
            lines = np.repeat(batch.column("hash").to_numpy().view(U64).astype(np.uint32), np.diff(bands.offsets.to_numpy()))
            held.append((own, lines))
            size += len(own)
            if size > 2_000_000:
                yield out(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield out(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _shared_keys(table: pa.Table) -> pa.Table:
    """The keys of a shard that two different lines have."""
    join = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(c)])
    keys, lines = join("keys", U64), join("lines", np.uint32)
    order = np.argsort(keys, kind="stable")
    keys, lines = keys[order], lines[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    good = np.minimum.reduceat(lines, begin) < np.maximum.reduceat(lines, begin)
    return pa.table({"hash": keys[begin][good].view(np.int64)})


def _texts(bits: int, flags):
    """The texts of the lines that pairs ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = flags.value
        for _, data, offsets in text_blocks(batches, "text"):
            lines = Lines(data, offsets)
            which = np.unique(lines.hash, return_index=True)[1]
            which = which[_hit(seen, mix(lines.hash[which]), bits)]
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(lines.starts[which].tolist(), lines.ends[which].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(lines.hash[which].view(np.int64)), pa.array(texts, pa.binary())], names=["hash", "text"])

    return run


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The distinct shingles (lower halves of their hashes) of the lines of a batch."""
    out = []
    for _, data, offsets in text_blocks([batch], "text", 1 << 20):
        tokens, begin = shingles(data, offsets[:-1], offsets[1:])
        own = distinct((np.repeat(np.arange(len(begin) - 1, dtype=U64), np.diff(begin)) << U64(32)) | (tokens >> U64(32)))
        first = np.searchsorted(own, np.arange(len(begin), dtype=U64) << U64(32)).tolist()
        short = own.astype(np.uint32)
        out += [short[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def line_components(docs: DataFrame, least: float = 0.8, bands: int = 12, rows: int = 5, share: int = 4096, early: int = 4, bits: int = 26) -> tuple[DataFrame, DataFrame]:
    """(lines, labels): every visible line (doc_id, text_hash, line, hash), and (node, component) of the lines that are linked to another."""
    if bands * rows > BINS:
        raise ValueError(f"bands * rows must be {BINS} at most")
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).filter("doc_id IS NOT NULL")
    send = docs.sparkSession.sparkContext.broadcast
    lines = stored(texts.mapInArrow(_read(bands, rows), LINES), "lines")
    signed = lines.filter(F.size("bands") > 0).select("bands", "hash")
    shards = 1 << max(6, (lines.count() * 2 * bands // 1_000_000).bit_length())
    keys = signed.mapInArrow(_keys(shards), "shard long, keys binary, lines binary")
    flags = send(bitmap(keys.groupBy("shard").applyInArrow(_shared_keys, "hash long"), bits))
    held = stored(signed.mapInArrow(_wanted(bits, flags), "bucket long, item long").distinct(), "held")
    counts = stored(held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("pivot")).filter("n > 1"), "counts")
    found = stored(held.join(counts, "bucket"), "found")
    asked = send(bitmap(found.select(F.col("item").alias("hash")).mapInArrow(_mixed, "hash long"), bits))
    known = texts.select("text").mapInArrow(_texts(bits, asked), "hash long, text binary").dropDuplicates(["hash"])
    known = stored(known.withColumnRenamed("hash", "item"), "texts")
    groups = None
    turn = F.pmod("bucket", F.lit(bands))
    for of_round in (turn < early, turn >= early):
        rows = parts(found.filter(of_round), share)
        rows = rows.withColumn("label", F.col("item")) if groups is None else mixed(stored(labelled(rows, groups), "labelled"))
        groups = joined(groups, compared(rows.join(known, "item"), _sets, least))
    large = found.filter(F.col("n") > share)
    if not large.isEmpty():
        large = stored(labelled(large, groups), "large")
        groups = joined(groups, compared(cells(large, share).join(known, "item"), _sets, least))
    return lines.drop("bands"), groups


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mix(batch.column("hash").to_numpy().view(U64)).view(np.int64))], names=["hash"])


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, removed (line numbers from 0, ascending); options as line_components()."""
    lines, labels = line_components(docs, **options)
    grouped = lines.join(labels.withColumnRenamed("node", "hash"), "hash", "left")
    grouped = stored(grouped.select("doc_id", "text_hash", "line", F.coalesce("component", "hash").alias("group")), "grouped")
    at = F.struct("doc_id", "text_hash", "line")
    first = stored(grouped.groupBy("group").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first < last").drop("last"), "first")
    gone = grouped.join(first, "group").filter(at != F.col("first")).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    text = F.col("text").cast("string")
    whole = F.coalesce(text, F.lit(""))
    n_lines = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), n_lines.cast("long").alias("n_lines"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.join(gone, ["doc_id", "text_hash"], "left").select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs, each id with one text, with the lines of line_dedup()'s result cut from their texts."""
    rows = docs.join(removed.select("doc_id", "removed").dropDuplicates(["doc_id"]), "doc_id", "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("removed"), i))
    return rows.withColumn("text", F.when(F.size("removed") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))).select(docs.columns)
