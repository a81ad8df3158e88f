"""Language-model scoring by an Elias-Fano n-gram trie.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z in lower case, then
one end. The trie has a level for each n-gram length up to ``order``:

* Level 1 is the sorted 64-bit hashes of the training words (their rank is the
  word's number), with exact counts.
* Level n holds, for each node of level n-1 (a context), its following words:
  a monotone pointer to the context's range and the words' numbers, made
  monotone over the whole level by adding the last value of the range before.
  A word is looked up by successor search for its number relative to its
  context. Beside each stands its smoothed log10 probability, and beside each
  context the weight of the shorter context, both quantised to 1/4096.

All sequences are Elias-Fano coded. The trie is cut into shards by the hash of
the first word, so a shard holds whole subtrees. The texts are read twice: for
the words, then for the n-grams of all levels, which point to each other by their
places in the sorted lists that a task sums, so that no count is looked up in the
trie. One task builds the sequences of a shard from these lists; then the
probabilities are added level by level, as they need the level before in all
shards. The files are in the shared folder, memory-mapped by every worker that
scores.

Smoothing is Witten-Bell: ``P(w|c) = (n(c,w) + k T(c) P(w|c')) / (n(c) + k T(c))``,
n: counts, T: distinct following words, c': the context without its first word,
k: ``prior``; at the end ``(c + 0.1) / (N + 0.1 (V + 1))``, so unknown words have
probability too.

The number of shards follows the bytes of text, so a shard's size does not grow,
save for the part of a very frequent first word or of the start of a text.
A context is the words since the start of the text at most; the start itself
is a context of its own.

Defined results: null and empty texts have the end alone; with nothing to learn
from N and V are 0 and every token is unknown; repeated rows count and are
scored each. Columns other than id and text are not read.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.elias_fano import EliasFano, encode
from tandem.llm.hashing import LOWER, SPACE, cut, text_blocks, word_hashes
from tandem.llm.storage import new_path

U64 = np.uint64
END = U64(0x5851F42D4C957F2D)
STEP = 1 / 4096
SHARD_BYTES = 16 << 20
FLUSH = 1_500_000
PIECE = 1 << 20


# Files


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: the length of a head, the head (JSON: place, type and length of each array), the arrays."""
    at, head = 0, {}
    for name, x in arrays.items():
        head[name] = (at, x.dtype.str, len(x))
        at += -(-x.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    fs, own = pa.fs.FileSystem.from_uri(path)
    draft = f"{own}.{os.getpid()}-{os.urandom(4).hex()}"
    with fs.open_output_stream(draft) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for x in arrays.values():
            out.write(np.ascontiguousarray(x).tobytes() + b"\0" * (-x.nbytes % 64))
    fs.move(draft, own)  # a task that runs twice writes the same


def read_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; a file of another store is first copied to an unnamed local file."""
    fs, own = pa.fs.FileSystem.from_uri(path)
    if fs.type_name == "local":
        with open(own, "rb") as f:
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with tempfile.TemporaryFile() as f, fs.open_input_stream(own) as source:
            while piece := source.read(1 << 24):
                f.write(piece)
            f.flush()
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    size = int.from_bytes(held[:8], "little")
    head = json.loads(held[8 : 8 + size])
    return {name: np.frombuffer(held, kind, n, 8 + size + at) for name, (at, kind, n) in head.items()}


def uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:/") else f"file://{path}"


# Counting


def sums_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of the counts of each."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begin], np.add.reduceat(counts, begin)


class Tokens:
    """The tokens of a block: their hashes, and where each text's begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        starts, ends, first = cut(data, offsets, SPACE)
        # by pieces, so that the powers that hashing uses stay few and are kept
        edges = np.searchsorted(starts, np.arange(0, len(data) + PIECE, PIECE))
        words = np.empty(len(starts), U64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if a < b:
                at = starts[a]
                words[a:b] = word_hashes(data[at : ends[b - 1]], starts[a:b] - at, ends[a:b] - at)
        words[words == END] = END + U64(1)
        n = len(offsets) - 1
        self.first = first + np.arange(n + 1)
        self.hash = np.empty(len(words) + n, U64)
        is_end = np.zeros(len(self.hash), bool)
        is_end[self.first[1:] - 1] = True
        self.hash[is_end], self.hash[~is_end] = END, words
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        self.place = np.arange(len(self.hash)) - self.first[self.doc]


def _planes(x: np.ndarray) -> bytes:
    """Integers as bytes, the lowest byte of each first: the upper ones are mostly zero and compress well."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(parts: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel() for x in parts]


def _steps(x: np.ndarray) -> bytes:
    """Sorted integers by their differences."""
    return _planes(np.diff(x, prepend=x.dtype.type(0)))


def _blobs(shard: np.ndarray, arrays: list[np.ndarray], shards: int) -> pa.RecordBatch:
    """One row for each shard: its part of some arrays that are sorted by shard."""
    edges = np.searchsorted(shard, np.arange(shards + 1))
    live = np.flatnonzero(np.diff(edges))
    parts = [[x[edges[s] : edges[s + 1]].tobytes() for s in live] for x in arrays]
    return pa.RecordBatch.from_arrays([pa.array(live, pa.int64()), *(pa.array(p, pa.binary()) for p in parts)], names=["shard", *"abc"[: len(arrays)]])


def _words(shards: int):
    shift = U64(64 - shards.bit_length() + 1)

    def out(keys, counts):
        return _blobs((keys >> shift).astype(np.int64), [keys, counts.astype(np.int64)], shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        for _, data, offsets in text_blocks(batches, "text"):
            own = Tokens(data, offsets).hash
            own, n = sums_by_key(own, np.ones(len(own), np.int64))
            keys, counts = sums_by_key(np.concatenate([keys, own]), np.concatenate([counts, n]))
            if len(keys) > FLUSH:
                yield out(keys, counts)
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield out(keys, counts)

    return run


def _build_words(path: str, shards: int):
    shift = 64 - shards.bit_length() + 1

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        join = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(c)])
        keys, counts = sums_by_key(join("a", U64), join("b", np.int64))
        write_arrays(f"{path}/1-{shard}", encode(keys - U64(shard << shift), "key") | {"count": counts})
        return pa.table({"shard": [shard], "nodes": [len(keys)], "tokens": [int(counts.sum())]})

    return run


# The trie


class Trie:
    """The levels as files. sizes[n - 1][s]: the nodes of level n in shard s; tokens: N."""

    def __init__(self, path: str, shards: int, prior: float, tokens: int, sizes: list[list[int]]):
        self.path, self.shards, self.prior, self.tokens = path, shards, prior, tokens
        self.sizes = sizes
        self.open: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    @property
    def words(self) -> int:
        return sum(self.sizes[0])

    def offsets(self, level: int) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes[level - 1])])

    def part(self, level: int, shard: int) -> dict:
        """The sequences of a shard, and the counts of its nodes (level 1) or as stored by _build_shapes()."""
        key = level, shard
        if key not in self.open:
            arrays = read_arrays(f"{self.path}/{level}-{shard}")
            names = ("key",) if level == 1 else ("begin", "word")
            self.open[key] = arrays | {name: EliasFano(arrays, name) for name in names}
        return self.open[key]

    def values(self, level: int, shard: int) -> dict[str, np.ndarray]:
        """What stands beside the nodes of a level (probability) and their contexts (weight)."""
        key = level, shard, "values"
        if key not in self.open:
            self.open[key] = read_arrays(f"{self.path}/{level}-{shard}-values")
        return self.open[key]

    def _by_shard(self, level: int, nodes: np.ndarray):
        """Runs of a sorted array of nodes that lie in one shard: shard, slice, numbers within the shard."""
        offsets = self.offsets(level)
        edges = np.searchsorted(nodes, offsets)
        for s in np.flatnonzero(np.diff(edges)):
            at = slice(edges[s], edges[s + 1])
            yield s, at, nodes[at] - offsets[s]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of sorted distinct hashes; -1 if unknown."""
        out = np.full(len(hashes), -1, np.int64)
        bits = self.shards.bit_length() - 1
        offsets = self.offsets(1)
        edges = np.searchsorted((hashes >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(edges)):
            if self.sizes[0][s]:
                at = slice(edges[s], edges[s + 1])
                keys = self.part(1, s)["key"]
                value = hashes[at] - U64(int(s) << (64 - bits) if bits else 0)
                found = keys.index(value)
                out[at] = np.where(found >= 0, found + offsets[s], -1)
        return out

    def counts(self, words: np.ndarray) -> np.ndarray:
        """Counts of sorted word numbers (-1: 0)."""
        out = np.zeros(len(words), np.int64)
        known = np.searchsorted(words, 0)
        for s, at, local in self._by_shard(1, words[known:]):
            out[known + at.start : known + at.stop] = self.part(1, s)["count"][local]
        return out

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of (c + 0.1) / (N + 0.1 (V + 1))."""
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.words + 1)))

    def children(self, level: int, nodes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The nodes of a level for pairs, sorted, of a node of the level before and a word; -1 if there is none."""
        out = np.full(len(nodes), -1, np.int64)
        offsets = self.offsets(level)
        for s, at, local in self._by_shard(level - 1, nodes):
            if not self.sizes[level - 1][s]:
                continue
            part = self.part(level, s)
            fresh = np.concatenate([[True], local[1:] != local[:-1]])
            context, inverse = local[fresh], np.cumsum(fresh) - 1
            low, high = (x.astype(np.int64) for x in part["begin"].pair(context))
            base = np.zeros(len(context), U64)
            base[low > 0] = part["word"].get(low[low > 0] - 1)
            low, high, base = low[inverse], high[inverse], base[inverse]
            value = base + (np.maximum(words[at], 0) + 1).astype(U64)
            # in rising order, as the search wants it: a value above one of a later context is beyond its own range, and stays so
            value = np.minimum.accumulate(value[::-1])[::-1]
            found = part["word"].index(value)
            ok = (found >= low) & (found < high) & (words[at] >= 0)
            out[at] = np.where(ok, found + offsets[s], -1)
        return out

    def _codes(self, level: int, name: str, nodes: np.ndarray) -> np.ndarray:
        """Quantised values beside sorted nodes."""
        out = np.zeros(len(nodes))
        for s, at, local in self._by_shard(level, nodes):
            values = self.values(level if name == "probability" else level + 1, s)
            out[at] = values[name][local].astype(float) * -STEP
        return out

    def step(self, level: int, node: np.ndarray, words: np.ndarray, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """The nodes of a level for rows of a context node and a word (-1: none), and with low, the log10 probabilities by
        shorter contexts, those by this one. Each distinct pair is looked up once."""
        child = np.full(len(node), -1, np.int64)
        live = np.flatnonzero(node >= 0)
        order, first = _runs(node[live], words[live])
        live, which = live[order], np.cumsum(first) - 1
        a, b = node[live[first]], words[live[first]]
        found = self.children(level, a, b)
        own = found[which]
        child[live] = own
        if low is None:
            return child, None
        hit, missed = np.flatnonzero(found >= 0), np.flatnonzero(found < 0)  # sorted, as their pairs are
        add = np.empty(len(a))
        add[hit], add[missed] = self._codes(level, "probability", found[hit]), self._codes(level - 1, "weight", a[missed])
        low = low.copy()
        low[live] = np.where(own >= 0, 0.0, low[live]) + add[which]
        return child, low

    def score(self, context: np.ndarray, words: np.ndarray, levels: int) -> np.ndarray:
        """log10 P(word | context) for rows of word numbers; context has the words before, last first, -1 beyond what is known."""
        out = self._low(words)
        for level in range(2, levels + 1):
            out = self.step(level, self.context_nodes(context[:, : level - 1]), words, out)[1]
        return out

    def score_texts(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token its word number, base and log10 probability. The context of a token is the node of the token before, one level up."""
        distinct, inverse = _distinct(tokens.hash)
        words = self.numbers(distinct)
        words, base = words[inverse], self._low(words)[inverse]
        score, node = base, self.before(tokens, words)
        for level in range(2, len(self.sizes) + 1):
            child, score = self.step(level, node, words, score)
            node = _shifted(child, tokens, -1)
        return words, base, score

    def _low(self, words: np.ndarray) -> np.ndarray:
        distinct, inverse = _distinct(words)
        return self.base(self.counts(distinct))[inverse]

    def context_nodes(self, context: np.ndarray) -> np.ndarray:
        """The node of each row's context (its words, last first); -1 if it is not in the trie."""
        node = context[:, -1]
        for level in range(2, context.shape[1] + 1):
            node = self.step(level, node, context[:, -level])[0]
        return node

    def way(self, level: int, shard: int) -> np.ndarray:
        """For each node of a shard its words, last first."""
        if level == 1:
            offset = self.offsets(1)
            return np.arange(offset[shard], offset[shard + 1])[:, None]
        part = self.part(level, shard)
        edges = part["begin"].all().astype(np.int64)
        value = part["word"].all()
        node = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        base = np.concatenate([[U64(0)], value])[edges[:-1]]
        return np.concatenate([(value - base[node] - U64(1)).astype(np.int64)[:, None], self.way(level - 1, shard)[node]], 1)

    def before(self, tokens: Tokens, words: np.ndarray) -> np.ndarray:
        """The word number before each token; before the first stands the end token, as the start of every text."""
        return _shifted(words, tokens, int(self.numbers(np.array([END], U64))[0]))


def _shifted(values: np.ndarray, tokens: Tokens, start: int) -> np.ndarray:
    """The value of the token before, start for the first of a text."""
    return np.where(tokens.place > 0, np.concatenate([[start], values[:-1]])[: len(values)], start)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and the place of each value among them (by a plain sort, faster here than np.unique)."""
    order = np.argsort(values)
    held = values[order]
    fresh = np.ones(len(held), bool)
    fresh[1:] = held[1:] != held[:-1]
    inverse = np.empty(len(held), np.int64)
    inverse[order] = np.cumsum(fresh) - 1
    return held[fresh], inverse


def _runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (a, b), and which rows in it are the first of their pair."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    if max(int(a.max()), int(b.max()) + 1) >> 31:
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        return order, np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    key = a.astype(np.int64)
    key <<= 32
    key += b
    key += 1
    order = np.argsort(key)
    key = key[order]
    return order, np.concatenate([[True], key[1:] != key[:-1]])


# Counts by level: for each level from 2 its distinct pairs, sorted, of a context and a word, and their counts. At level 2
# a context is a node of level 1, above it is the place of a pair in the list of the level before.
Counts = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _counted(trie: Trie, tokens: Tokens, order: int) -> Counts:
    """The counts of a block. A context that would begin before the start of the text has none."""
    distinct, inverse = _distinct(tokens.hash)
    words = trie.numbers(distinct)[inverse]
    node, out = trie.before(tokens, words), []
    for _ in range(2, order + 1):
        live = np.flatnonzero(node >= 0)
        rows, first = _runs(node[live], words[live])
        begin, live = np.flatnonzero(first), live[rows]
        at = live[begin]
        out.append((_small(node[at], trie), _small(words[at], trie), np.diff(begin, append=len(live)).astype(np.uint32)))
        node, child = np.full(len(words), -1, np.int64), np.cumsum(first) - 1
        node[live] = child
        node = _shifted(node, tokens, -1)
    return out


def _small(x: np.ndarray, trie: Trie) -> np.ndarray:
    return x.astype(np.int64 if trie.words >> 32 else np.uint32)


def _joined(parts: list[Counts]) -> Counts:
    """The counts of several parts as those of one."""
    out, starts, place = [], None, None
    for level in zip(*parts, strict=True):
        context, word, count = map(np.concatenate, zip(*level, strict=True))
        if starts is not None:  # a part's contexts follow those of the part before
            context = place[context + np.repeat(starts, [len(x[0]) for x in level])]
        starts = np.cumsum([0, *(len(x[0]) for x in level[:-1])])
        rows, first = _runs(context, word)
        begin = np.flatnonzero(first)
        place = np.empty(len(rows), np.uint32 if len(rows) >> 32 == 0 else np.int64)
        place[rows] = np.cumsum(first) - 1
        at = rows[begin]
        out.append((context[at], word[at], np.add.reduceat(count[rows], begin, dtype=np.int64) if len(begin) else count))
    return out


def _grams(trie: Trie, order: int):
    """Counts of all levels, as blobs by shard: for each level the context within the shard, word, count."""
    offsets = trie.offsets(1)

    def out(counts):
        edges, parts, base = None, [], offsets
        for context, word, count in counts:
            edges = np.searchsorted(context, offsets if edges is None else edges)
            within = (context - np.repeat(base[:-1], np.diff(edges))).astype(np.uint32)
            parts.append((edges, (within, word, count.astype(np.uint32))))
            base = edges
        live = np.flatnonzero(np.diff(parts[0][0]))
        for at in range(0, len(live), 8):  # few at a time, for memory
            own = live[at : at + 8]
            blobs = [
                pa.array([way(x[edges[s] : edges[s + 1]]) for s in own], pa.binary())
                for edges, arrays in parts for x, way in zip(arrays, (_steps, _planes, _planes), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *blobs], names=["shard", *_columns(order)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, data, offsets_ in text_blocks(batches, "text", 1 << 22):
            held.append(_counted(trie, Tokens(data, offsets_), order))
            size += max(len(x[0]) for x in held[-1])
            if size > FLUSH:
                held, size = [_joined(held)], 0
                yield from out(held.pop())
        if held:
            yield from out(_joined(held))

    return run


def _columns(order: int) -> list[str]:
    return [f"{x}{level}" for level in range(2, order + 1) for x in "abc"]


def _build_shapes(trie: Trie, order: int):
    """Sums the counts of a shard and writes the sequences of each level, with the counts: in a byte each, large ones beside."""
    kind = np.int64 if trie.words >> 32 else np.uint32

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        levels = []
        for level in range(2, order + 1):
            a, b, c = (_from_planes(table.column(f"{x}{level}"), k) for x, k in (("a", np.uint32), ("b", kind), ("c", np.uint32)))
            levels.append([(np.cumsum(x, dtype=np.int64), y, z.astype(np.int64)) for x, y, z in zip(a, b, c, strict=True)])
        contexts, sizes = trie.sizes[0][shard], []
        for level, (node, word, count) in enumerate(_joined(list(zip(*levels, strict=True))), 2):
            kinds = np.bincount(node, minlength=contexts)
            edges = np.concatenate([[0], np.cumsum(kinds)])
            last = np.zeros(contexts, U64)
            live = kinds > 0
            last[live] = word[edges[1:][live] - 1].astype(U64) + U64(1)
            base = np.concatenate([[U64(0)], np.cumsum(last)[:-1]])
            large = np.flatnonzero(count > 254)
            arrays = encode(edges, "begin") | encode(base[node] + word.astype(U64) + U64(1), "word")
            write_arrays(f"{trie.path}/{level}-{shard}", arrays | {"count": np.minimum(count, 255).astype(np.uint8), "large": large, "large.count": count[large]})
            contexts = len(node)
            sizes.append(contexts)
        return pa.table({"shard": [shard], "nodes": pa.array([sizes], pa.list_(pa.int64()))})

    return run


def _build_values(trie: Trie, level: int):
    """Writes the probabilities and weights of a level; those of the level before are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                build(shard)
            yield batch

    def build(shard):
        if not trie.sizes[0][shard]:
            return
        part, contexts = trie.part(level, shard), trie.sizes[level - 2][shard]
        count = part["count"].astype(np.int64)
        count[part["large"]] = part["large.count"]
        kinds = np.diff(part["begin"].all().astype(np.int64))
        node = np.repeat(np.arange(contexts), kinds)
        total = np.bincount(node, count, contexts)
        pull = trie.prior * kinds
        way = trie.way(level, shard)
        # the context without its first word: the words on the way to this node
        low = trie._low(way[:, 0]) if level == 2 else trie.score(way[:, 1 : level - 1], way[:, 0], level - 1)
        probability = np.log10((count + pull[node] * 10.0**low) / (total[node] + pull[node]))
        weight = np.where(kinds > 0, np.log10(np.maximum(pull, 1e-300) / np.maximum(total + pull, 1e-300)), 0.0)
        code = lambda x: np.round(np.clip(-x / STEP, 0, 65535)).astype(np.uint16)
        write_arrays(f"{trie.path}/{level}-{shard}-values", {"probability": code(probability), "weight": code(weight)})

    return run


BUILT = "shard long, nodes long, tokens long"


def train(texts: DataFrame, order: int = 2, prior: float = 1.0) -> Trie:
    """Build the trie of the column text of all rows."""
    if order < 1:
        raise ValueError("order must be 1 or more")
    spark = texts.sparkSession
    texts = texts.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 << max(4, int(size // SHARD_BYTES).bit_length())
    path = uri(new_path(spark, "trie"))
    fs, own = pa.fs.FileSystem.from_uri(path)
    fs.create_dir(own, recursive=True)
    found = texts.mapInArrow(_words(shards), "shard long, a binary, b binary").groupBy("shard").applyInArrow(_build_words(path, shards), BUILT)
    built = {r.shard: r for r in found.collect()}
    trie = Trie(path, shards, prior, sum(r.tokens for r in built.values()), [[built[s].nodes if s in built else 0 for s in range(shards)]])
    if order > 1:
        found = texts.mapInArrow(_grams(trie, order), ", ".join(["shard long", *(f"{c} binary" for c in _columns(order))]))
        built = {r.shard: r.nodes for r in found.groupBy("shard").applyInArrow(_build_shapes(trie, order), "shard long, nodes array<long>").collect()}
        none = [0] * (order - 1)
        trie = Trie(path, shards, prior, trie.tokens, trie.sizes + [list(x) for x in zip(*(built.get(s, none) for s in range(shards)), strict=True)])
    for level in range(2, order + 1):  # a level's values need those of the level before, of all shards
        spark.range(0, shards, 1, shards).mapInArrow(_build_values(trie, level), "id long").count()
    return trie


def lm_score(docs: DataFrame, trie: Trie) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for rows, data, offsets in text_blocks(batches, "text", 1 << 22):
            tokens = Tokens(data, offsets)
            n = rows.num_rows
            words, base, score = known.score_texts(tokens)
            sums = lambda x: np.bincount(tokens.doc, x, n)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), pa.array(np.diff(tokens.first), pa.int64()), pa.array(sums(words >= 0).astype(np.int64)),
                    pa.array(np.full(n, known.tokens), pa.int64()), pa.array(sums(base)), pa.array(sums(score)),
                ],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
