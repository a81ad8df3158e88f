"""N-gram Jaccard self-join by chosen paths.

Texts are sets of shingles of five words (``[^\\x20\\x09-\\x0D]+``, unchanged; a
shorter text is one shingle). Two texts are linked when the Jaccard similarity
of their sets is ``least`` (0.8) or more.

1. Texts with equal sets form a class, of which one row stands for all from here on.
2. In each run a set follows paths: at a node it takes each of its shingles with
   probability 1 / (least * size), by a hash of run, path and shingle, so sets
   that share a shingle take it together. Sets at one node are a bucket. A pair at
   the threshold shares 1 / least branches a node on average, and 1 if one set
   contains the other, so it is still together at a node of depth 1, 2, 3 with
   probability 0.63, 0.47, 0.37 at least; ``runs`` follows from ``recall`` (0.99) for
   the largest depth (10 runs), and most nodes are small at depth 1 (recall 0.9999).
   The runs are repeated in two rounds: the first ``early`` runs join most of what is
   linked, so that in the others only sets of different groups are compared.
3. A node of at most ``limit`` sets is compared by brute force: sets without a
   partner by a signature of 40 bytes are out, the others are compared exactly (see
   buckets.py: a linked pair is passed over with a probability below one in a million).
4. A larger node is first collapsed: it is dealt out in parts, and what is linked
   in a part is one group. A node of one group is done. One with few sets outside
   its largest group is compared in cells, each part of the group with all these
   sets; any other is split at the next shingle of the path, down to ``depth``
   shingles, where the nodes left are compared in cells.
5. Verified links are joined to groups by union-find.

Defined results: class_id is the smallest id of the group; n_links is the number
of other sets (classes of equal sets) in the group that the document's own is
linked to, with count_links False it is left out. Counting compares all sets of a
group and so costs the square of a group's size in bit operations, though rows
only in proportion to its number of parts. A text without words (null or empty
too) is alone; repeated rows of one id are one document, and if their texts
differ they stand for the id with each of these texts; a row with a null id has
null as class and no links. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.buckets import cells, compared, degrees, hopeful, joined, labelled, mixed, parts, signatures
from tandem.llm.hashing import SPACE, cut, distinct, mix, prefix_sums, release, span_hashes, text_blocks, word_hashes
from tandem.llm.storage import stored
from tandem.llm.substring_dedup import bitmap

U64 = np.uint64


def runs_for(recall: float, depth: int) -> int:
    """Runs that find a pair at the threshold with this probability, even if one set contains the other and only nodes of the last depth are compared."""
    together = 1.0
    for _ in range(depth):
        together = 1 - math.exp(-together)
    return math.ceil(math.log(1 - recall) / math.log(1 - together))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a block, sorted within a text, and where each text's begin."""
    starts, ends, first = cut(data, offsets, SPACE)
    sums = prefix_sums(word_hashes(data, starts, ends))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        at = np.arange(a, max(b - words, a) + 1) if b > a else np.zeros(0, np.int64)
        out.append(distinct(span_hashes(sums, at, np.minimum(at + words, b))))
    sizes = np.array([len(x) for x in out])
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(sizes)])


def paths(tokens: np.ndarray, begin: np.ndarray, run: int, depth: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leaves of each set's paths in a run: set, keys of the nodes (n x depth, 0 beyond the end), and first-of-its-node flags."""
    size = np.diff(begin)
    limit = (2.0**64 / np.maximum(least * size, 1.0001)).astype(U64)
    doc, key = np.arange(len(size)), np.full(len(size), mix(np.array([run + 1], U64))[0])
    keys = np.zeros((len(size), 0), U64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(depth):
        n = size[doc]
        owner = np.repeat(np.arange(len(doc)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin[doc], n)
        token = tokens[at].astype(U64)
        taken = np.flatnonzero(mix(token ^ key[owner]) < limit[doc[owner]])
        owner = owner[taken]
        ended = np.ones(len(doc), bool)
        ended[owner] = False
        if level:
            done.append((doc[ended], np.pad(keys[ended], ((0, 0), (0, depth - level)))))
        key = mix(key[owner] * U64(0x9E3779B97F4A7C15) + token[taken])
        key[key == 0] = 1
        keys = np.concatenate([keys[owner], key[:, None]], 1)
        doc = doc[owner]
    done.append((doc, keys))
    doc, keys = np.concatenate([d for d, _ in done]), np.concatenate([k for _, k in done])
    order = np.lexsort((*keys.T[::-1], doc))
    doc, keys = doc[order], keys[order]
    first = np.ones(keys.shape, bool)
    first[1:] = np.logical_or.accumulate((keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])[:, None], axis=1)
    return doc, keys, first & (keys != 0)


def _profiles(words: int, runs: int, least: float):
    """Of each text: its set (upper halves of the hashes), two hashes of it, its signature, and the nodes of depth 1 of all runs, run by run."""
    node = pa.struct([("run", pa.int32()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, "text", 1 << 20):
            tokens, begin = shingle_sets(data, offsets, words)
            sums = [np.concatenate([[U64(0)], np.cumsum(mix(tokens ^ U64(s)))]) for s in (1, 2)]
            h1, h2 = ((s[begin[1:]] - s[begin[:-1]]).view(np.int64) for s in sums)
            short = (tokens >> U64(32)).astype(np.uint32)
            fresh = np.ones(len(short), bool)
            fresh[1:] = short[1:] != short[:-1]
            fresh[begin[begin < len(short)]] = True
            short, begin = short[fresh], np.concatenate([[0], np.cumsum(fresh)])[begin]
            found = [paths(short, begin, r, 1, least)[:2] for r in range(runs)]
            doc, keys = (np.concatenate(x) for x in zip(*found, strict=True))
            number = np.repeat(np.arange(runs, dtype=np.int32), [len(x[0]) for x in found])
            order = np.argsort(doc, kind="stable")
            ends = np.searchsorted(doc[order], np.arange(rows.num_rows + 1)).astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(number[order]), pa.array(keys[order, 0].view(np.int64))], fields=list(node))
            raw = short.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), pa.array(np.diff(begin)), pa.array(h1), pa.array(h2),
                    pa.array([raw[4 * a : 4 * b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], pa.binary()),
                    pa.array([x.tobytes() for x in signatures(short, begin)], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat),
                ],
                names=["doc_id", "size", "h1", "h2", "tokens", "sign", "nodes"],
            )

    return run, "doc_id long, size long, h1 long, h2 long, tokens binary, sign binary, nodes array<struct<run:int,key:long>>"


def _held(bits: int, flags):
    """The rows whose hash the bitmap holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = flags.value
        for batch in batches:
            index = (batch.column("hash").to_numpy().view(U64) >> U64(64 - bits)).astype(np.int64)
            yield batch.filter(pa.array((seen[index >> 3] >> (7 - (index & 7)).astype(np.uint8)) & 1 == 1)).select(["item", "tokens"])
        release()

    return run


def _with_sets(rows: DataFrame, payload: DataFrame, bits: int) -> DataFrame:
    """rows with their items' sets; the sets of other items are left out before the shuffle."""
    hashed = F.xxhash64("item").alias("hash")
    flags = rows.sparkSession.sparkContext.broadcast(bitmap(rows.select(hashed), bits))
    return rows.join(payload.select(hashed, "item", "tokens").mapInArrow(_held(bits, flags), "item long, tokens binary"), "item")


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column("tokens")]


def _leaves(runs: int, depth: int, least: float):
    """The paths of sets (item, tokens) below depth 1, a row for each leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                held = _sets(batch)
                begin = np.concatenate([[0], np.cumsum([len(x) for x in held])])
                tokens = np.concatenate(held)
                for r in range(runs):
                    doc, keys, first = paths(tokens, begin, r, depth, least)
                    columns = [pa.array(np.ascontiguousarray(keys[:, i]).view(np.int64)) for i in range(depth)]
                    columns += [pa.array(np.ascontiguousarray(first[:, i])) for i in range(depth)]
                    yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(doc)), *columns], names=["item", *(f"{c}{i}" for c in "kf" for i in range(depth))])
        release()

    return run, "item long, " + ", ".join([*(f"k{i} long" for i in range(depth)), *(f"f{i} boolean" for i in range(depth))])


def _nodes_of_groups(large: DataFrame, payload: DataFrame, runs: int, depth: int, least: float, limit: int) -> DataFrame:
    """(bucket, item, label): the nodes at which the sets of large nodes (bucket, item, label) of depth 1 are compared further."""
    done, rows, leaves = None, large, None
    for level in range(depth):
        last = level == depth - 1
        if level:
            rows = leaves.filter(f"f{level}").select(F.col(f"k{level}").alias("bucket"), "item", "label")
        counts = rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max("n").alias("main"), F.sum("n").alias("n"))
        apart = F.col("n") - F.col("main")
        counts = stored(counts.filter(apart > 0).select("bucket", ((F.col("n") <= limit) | (apart <= limit // 2) | F.lit(last)).alias("ready")), "mixed")
        here = rows.join(counts.filter("ready"), "bucket", "left_semi")
        here = here.select(F.xxhash64(F.lit(level), "bucket").alias("bucket"), "item", "label")
        done = here if done is None else done.union(here)
        down = counts.filter("NOT ready").select("bucket")
        if last or down.isEmpty():
            return done
        if not level:
            down = rows.join(down, "bucket", "left_semi")
            run, schema = _leaves(runs, depth, least)
            leaves = payload.join(down.select("item").distinct(), "item", "left_semi").mapInArrow(run, schema)
            leaves = stored(leaves.join(down.withColumnRenamed("bucket", "k0"), ["item", "k0"]), "leaves")
        else:
            leaves = stored(leaves.join(down.withColumnRenamed("bucket", f"k{level}"), f"k{level}", "left_semi"), "leaves")
    raise ValueError("depth must be 1 or more")


def jaccard_join(
    docs: DataFrame, least: float = 0.8, words: int = 5, recall: float = 0.99, depth: int = 3, limit: int = 4096, runs: int | None = None,
    early: int = 3, filter_bits: int = 24, count_links: bool = True,
) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links (unless count_links is False).

    limit: the most sets that are compared at once; filter_bits: of the bitmap of items whose sets are sent, which changes no result.
    """
    runs = runs or runs_for(recall, depth)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run, schema = _profiles(words, runs, least)
    profiles = stored(texts.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "profiles")
    known = profiles.filter("doc_id IS NOT NULL AND size > 0")
    classes = stored(known.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min("row").alias("item")), "classes")
    payload = profiles.select(F.col("row").alias("item"), "tokens")
    nodes = known.select(F.col("row").alias("item"), "sign", "nodes").join(classes.select("item"), "item", "left_semi")
    signs = stored(nodes, "signs")
    nodes = stored(signs.select(F.explode("nodes").alias("node"), "item").select(F.col("node.run").alias("run"), F.col("node.key").alias("bucket"), "item"), "nodes")
    counts = nodes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("pivot")).filter("n > 1")
    nodes = stored(nodes.join(stored(counts, "counts"), "bucket"), "nodes")
    groups = None
    for of_round in (F.col("run") < early, F.col("run") >= early):
        rows = parts(nodes.filter(of_round), limit)
        rows = rows.withColumn("label", F.col("item")) if groups is None else mixed(stored(labelled(rows, groups), "labelled"))
        rows = stored(hopeful(rows.join(signs.select("item", "sign"), "item"), least), "hopeful")
        groups = joined(groups, compared(_with_sets(rows, payload, filter_bits), _sets, least))
    large = nodes.filter(F.col("n") > limit)
    if not large.isEmpty():
        large = stored(labelled(large.select("bucket", "item"), groups), "large")
        apart = stored(_nodes_of_groups(large, payload, runs, depth, least, limit), "apart")
        rows = stored(hopeful(cells(apart, limit).join(signs.select("item", "sign"), "item"), least), "hopeful")
        groups = joined(groups, compared(_with_sets(rows, payload, filter_bits), _sets, least))
    groups = groups.select(F.col("node").alias("item"), "component")
    ids = groups.join(classes.select("item", "rep"), "item").groupBy("component").agg(F.min("rep").alias("first"))
    labels = groups.join(ids, "component").select("item", "first")
    if count_links:
        found = degrees(groups, lambda rows: _with_sets(rows, payload, filter_bits), _sets, least, limit)
        labels = labels.join(found.withColumnRenamed("n", "n_links"), "item", "left")
    labels = classes.join(stored(labels, "labels"), "item", "left")
    members = profiles.select("doc_id", "size", "h1", "h2").join(labels, ["h1", "h2"], "left")
    alone = F.col("doc_id").isNull() | (F.col("size") == 0)
    out = [F.when(alone, F.col("doc_id")).otherwise(F.coalesce("first", "rep")).alias("class_id")]
    if count_links:
        out.append(F.when(alone, 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"))
    return members.select("doc_id", *out)
