"""SentencePiece encoding and decoding, with a max-plus scan for giant documents.

The vocabulary file holds a BPE model. A token sequence is the BPE encoding of
its text exactly when each two neighbours are the encoding of their own
concatenation, so the encoding is the one path of weight 0 in a graph whose
states are tokens at their places and whose steps weigh 0 between such
neighbours and minus infinity otherwise. The results are the ids that the
sentencepiece library gives for the whole text.

A document of more than ``chunk`` characters is cut into chunks at fixed
positions. A boundary's states are the tokens that cover the character before
it. Each chunk yields the max-plus matrix between the states of its two
boundaries; the matrices of a document are multiplied as a scan (the product is
associative), which leaves one state at each boundary; then each chunk is
traced back alone between its two states.

No token runs over a cut, the place before a space that follows another
character. From the first cut of a chunk to its last, all paths agree, so the
matrix needs only the characters before the first and after the last; the text
between is traced back from cut to cut, where each segment's encoding stands
alone and is remembered. A chunk without a cut is searched entirely. A document
of one chunk has no inner boundary.

Only models of this kind are taken: BPE, identity normaliser with a space
before the text, byte fallback. The library writes a space as U+2581, so that
character decodes to a space.

Defined results: a null or empty text has no tokens and decodes to an empty text;
repeated rows are encoded each. Columns other than id, text and those to carry
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm.hashing import release
from tandem.llm.storage import stored

SPACE = "▁"
#: A segment: spaces, then what follows up to the next space.
SEGMENT = re.compile(" +[^ ]*")


def default_model() -> str:
    """The SentencePiece vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Memo(dict):
    """Ids of segments, as bytes; emptied when it has grown to ``most`` entries."""

    def __init__(self, library, space: bytes, most: int = 100_000):
        super().__init__()
        self.library, self.space, self.most = library, space, most

    def __missing__(self, segment: str) -> bytes:
        found = np.array(self.library.encode(segment), np.int32).tobytes() if segment else self.space
        if len(segment) < 64:
            if len(self) >= self.most:
                self.clear()
            self[segment] = found
        return found


class Codec:
    """One vocabulary: the library's processor, and the graph's tokens and steps."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib = self.library
        self.size = lib.get_piece_size()
        special = lambda i: lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) or lib.is_byte(i)
        self.ids = {lib.id_to_piece(i): i for i in range(self.size) if not special(i)}
        self.scores = {piece: lib.get_score(i) for piece, i in self.ids.items()}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        self.known = Memo(lib, np.array(self.of([SPACE]), np.int32).tobytes())
        raw = [lib.id_to_piece(i).replace(SPACE, " ").encode() for i in range(self.size)]
        for i in range(self.size):
            if lib.is_control(i):
                raw[i] = b""
            elif lib.is_unknown(i):
                raw[i] = " \u2047 ".encode()
        for b, i in enumerate(self.bytes):
            raw[i] = bytes([b])
        self.piece_size = np.array([len(x) for x in raw], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.whole: dict[str, bool] = {}
        self.joined: dict[tuple[str, str], bool] = {}
        if lib.encode("a  b ") != self.of(self.merge(SPACE + "a  b ".replace(" ", SPACE))) or lib.encode("\x00") != self.of([SPACE, "\x00"]):
            raise ValueError("only BPE models with identity normaliser, a space before the text and byte fallback are supported")
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            raise ValueError("a piece runs over the end of a word")

    def of(self, pieces: list[str]) -> list[int]:
        """The ids of pieces; a character outside the vocabulary becomes its bytes."""
        out = []
        for piece in pieces:
            at = self.ids.get(piece)
            out += [at] if at is not None else [self.bytes[b] for b in piece.encode("utf-8", "replace")]
        return out

    def merge(self, text: str) -> list[str]:
        """BPE of a short string by its definition: again and again merge the neighbours of the best piece, the leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            score, at = max(((self.scores.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if score == -np.inf:
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def is_token(self, piece: str) -> bool:
        """Whether the piece is its own encoding (a character always is)."""
        if len(piece) == 1:
            return True
        if piece not in self.ids:
            return False
        if piece not in self.whole:
            self.whole[piece] = self.merge(piece) == [piece]
        return self.whole[piece]

    def fits(self, left: str, right: str) -> bool:
        """Whether the two tokens are the encoding of their concatenation."""
        key = left, right
        if key not in self.joined:
            if len(self.joined) > 50_000:
                self.joined.clear()
            self.joined[key] = self.merge(left + right) == [left, right]
        return self.joined[key]

    def covering(self, text: str, at: int) -> list[tuple[int, int]]:
        """The tokens (start, end) that cover the character before ``at``."""
        low = max(0, at - self.longest)
        return [(i, j) for i in range(low, at) for j in range(at, min(len(text), i + self.longest) + 1) if self.is_token(text[i:j])]

    def paths(self, text: str, begin: int, end: int, before: str | None) -> list[tuple[int, int] | None]:
        """For each place from begin to end + longest: the last token of the path from begin to it, if there is one.

        before: the token that ends at begin; None at a cut, where any may follow.
        """
        last: list[tuple[int, int] | None] = [None] * (min(len(text), end + self.longest) - begin + 1)
        for j in range(begin + 1, begin + len(last)):
            for i in range(max(begin, j - self.longest), min(j, end)):
                left = before if i == begin else last[i - begin] and text[slice(*last[i - begin])]
                if (left or (i == begin and before is None)) and self.is_token(text[i:j]) and (left is None or self.fits(left, text[i:j])):
                    last[j - begin] = (i, j)
                    break
        return last

    def trace(self, text: str, begin: int, end: int, before: str | None) -> list[str]:
        """The tokens of the path from begin to exactly end."""
        last, out = self.paths(text, begin, end, before), []
        while end > begin:
            i, j = last[end - begin]
            out.append(text[i:j])
            end = i
        return out[::-1]

    def segments(self, text: str) -> list[str]:
        """A text that stands between two cuts, cut at all cuts; each part without the space in front that every part has."""
        parts = text.split(" ")
        if "" in parts or SPACE in text:  # runs of spaces belong to what follows them
            parts = [x[1:] for x in SEGMENT.findall(" " + text.replace(SPACE, " "))] if text else []
        return parts

    def encode(self, text: str) -> bytes:
        """Ids (int32) of a text that stands between two cuts; the space in front is left out."""
        return b"".join(map(self.known.__getitem__, self.segments(text)))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and offsets of the texts of several lists of ids."""
        size = self.piece_size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(ends[-1]) + np.repeat(self.piece_start[ids] - ends[:-1], size)
        out, edges = self.piece_bytes[at], ends[offsets]
        full = np.flatnonzero(np.diff(edges))
        front = edges[:-1][full]
        front = front[out[front] == 0x20]  # the space before the text
        keep = np.ones(len(out), bool)
        keep[front] = False
        return out[keep], edges - np.searchsorted(front, edges)


class Chunk:
    """A piece of a document in written form: ``text`` with context; the chunk is [begin, end) of it."""

    def __init__(self, codec: Codec, text: str, begin: int, end: int, first: bool, last: bool):
        self.codec, self.text, self.begin, self.end = codec, text, begin, end
        cut = lambda i: i == 0 if first and i == begin else 0 < i < len(text) and text[i] == SPACE and text[i - 1] != SPACE
        self.first_cut = next((i for i in range(begin, end) if cut(i)), None)
        self.last_cut = next((i for i in range(end - 1, begin - 1, -1) if cut(i)), None)
        self.entries = [(begin, begin)] if first else codec.covering(text, begin)
        self.exits = [x for x in codec.covering(text, end) if not last or x[1] == end]
        self.first = first

    def _before(self, entry: tuple[int, int]) -> str | None:
        return None if self.first else self.text[slice(*entry)]

    def matrix(self) -> np.ndarray:
        """Max-plus weights between entry and exit states."""
        out = np.full((len(self.entries), len(self.exits)), -np.inf)
        codec = self.codec
        if self.first_cut is None:
            for e, entry in enumerate(self.entries):
                last = codec.paths(self.text, entry[1], self.end, self._before(entry))
                for x, (i, j) in enumerate(self.exits):
                    out[e, x] = 0.0 if (i, j) == entry or j > entry[1] and i >= entry[1] and last[j - entry[1]] == (i, j) else -np.inf
            return out
        into = np.full(len(self.entries), -np.inf)
        for e, entry in enumerate(self.entries):
            if entry[1] <= self.first_cut and (entry[1] == self.first_cut or codec.paths(self.text, entry[1], self.first_cut, self._before(entry))[self.first_cut - entry[1]]):
                into[e] = 0.0
        last = codec.paths(self.text, self.last_cut, self.end, None)
        leave = np.array([0.0 if i >= self.last_cut and last[j - self.last_cut] == (i, j) else -np.inf for i, j in self.exits])
        return into[:, None] + leave[None, :]

    def ids(self, entry: tuple[int, int], leave: tuple[int, int]) -> bytes:
        """The ids (int32) from the end of the entry token to the end of the exit token."""
        codec, text, before = self.codec, self.text, self._before(entry)
        traced = lambda a, b, left: np.array(codec.of(codec.trace(text, a, b, left)), np.int32).tobytes()
        if entry == leave:
            return b""
        if self.first_cut is None:
            return traced(entry[1], leave[1], before)
        middle = text[self.first_cut + 1 : self.last_cut].replace(SPACE, " ") if self.first_cut < self.last_cut else None
        middle = b"" if middle is None else codec.encode(middle)
        return traced(entry[1], self.first_cut, before) + middle + traced(self.last_cut, leave[1], None)


def lists(parts: list[bytes]) -> pa.ListArray:
    """Ids as an Arrow list array."""
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two matrices."""
    return (a[:, :, None] + b[None, :, :]).max(1) if a.shape[1] else np.full((a.shape[0], b.shape[1]), -np.inf)


def scan(matrices: list[np.ndarray]) -> list[int]:
    """The state at each boundary (one more than matrices) of the best path, by a tree of products as deep as the logarithm of their number."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([product(*row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)])
    whole = levels[-1][0]
    first, last = np.unravel_index(whole.argmax(), whole.shape)
    out = [int(first), int(last)]
    for row in levels[-2::-1]:  # down again: the state between the two halves of each product
        ends, out = out, []
        for i in range(0, len(row), 2):
            out.append(ends[i // 2])
            if i + 1 < len(row):
                out.append(int((row[i][ends[i // 2]] + row[i + 1][:, ends[i // 2 + 1]]).argmax()))
        out.append(ends[-1])
    return out


_codecs: dict[int, Codec] = {}


def _codec(sent) -> Codec:
    key = hash(sent.value)
    if key not in _codecs:
        _codecs[key] = Codec(sent.value)
    return _codecs[key]


def small(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows: ids as Python numbers take many times their size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def _short(sent, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for batch in small(batches):
            ids = lists([codec.encode(t) if t else b"" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *carry)), pa.array([1] * len(ids), pa.int32()), ids], names=["doc_id", *carry, "n_chunks", "ids"])

    return run


def _chunks(batch: pa.RecordBatch, codec: Codec) -> Iterator[tuple[int, Chunk]]:
    for row, (text, begin, end, k, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "begin", "end", "chunk", "n_chunks")), strict=True)):
        yield row, Chunk(codec, text, begin, end, k == 0, k == n - 1)


def _transfer(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for batch in small(batches, 32):
            out = [c.matrix() for _, c in _chunks(batch, codec)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("chunk"), pa.array([m.shape[0] for m in out], pa.int32()), pa.array([m.tobytes() for m in out], pa.binary())],
                names=["key", "chunk", "states", "matrix"],
            )

    return run


def _combine(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("chunk")
    matrices = [np.frombuffer(m).reshape(n, -1) for n, m in zip(rows["states"], rows["matrix"], strict=True)]
    states = scan(matrices)
    return pd.DataFrame({"key": rows["key"], "chunk": rows["chunk"], "entry": states[:-1], "leave": states[1:]})


def _back(sent, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for batch in small(batches, 32):
            entry, leave = batch.column("entry").to_pylist(), batch.column("leave").to_pylist()
            ids = [c.ids(c.entries[entry[row]], c.exits[leave[row]]) for row, c in _chunks(batch, codec)]
            names = ["key", "chunk", "n_chunks", "doc_id", *carry]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists(ids)], names=[*names, "ids"])

    return run


def encode(
    docs: DataFrame, model_path: str | None = None, chunk: int = 16_384, carry: tuple[str, ...] = (), then: tuple[Callable, str] | None = None
) -> DataFrame:
    """One row per row of docs: doc_id, the columns to carry, n_chunks and ids; or what ``then``, a function for mapInArrow and its schema, makes of these.

    ``then`` runs in the process that encodes, so a task needs no second one.
    """
    with open(model_path or default_model(), "rb") as f:
        model = f.read()
    longest = Codec(model).longest
    if chunk < 2 * longest:
        raise ValueError(f"chunk must be {2 * longest} or more")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary file, which does not grow with the input
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    kept = [f for f in rows.schema if f.name in carry]
    kinds = lambda *names: T.StructType.fromDDL(", ".join(names))
    size = F.length("text")
    encoded = T.StructType([*kinds("doc_id long"), *kept, *kinds("n_chunks int", "ids array<int>")])
    alone = _short(sent, list(carry))
    short = rows.filter(F.coalesce(size, F.lit(0)) <= chunk)
    short = short.mapInArrow(lambda batches: then[0](alone(batches)), then[1]) if then else short.mapInArrow(alone, encoded)
    giant = rows.filter(size > chunk).withColumn("key", F.monotonically_increasing_id())
    giant = giant.withColumn("written", F.concat(F.lit(SPACE), F.replace("text", F.lit(" "), F.lit(SPACE)))).withColumn("n", F.length("written"))
    giant = giant.withColumn("n_chunks", F.ceil(F.col("n") / chunk).cast("int"))
    low = lambda k: F.greatest(k * chunk - longest, F.lit(0))
    parts = F.transform(
        F.sequence(F.lit(0), F.col("n_chunks") - 1),
        lambda k: F.struct(
            k.alias("chunk"),
            F.substring(F.col("written"), low(k) + 1, F.lit(chunk + 2 * longest)).alias("part"),
            (k * chunk - low(k)).cast("int").alias("begin"),
            (F.least((k + 1) * chunk, F.col("n")) - low(k)).cast("int").alias("end"),
        ),
    )
    cut = stored(giant.select("key", "doc_id", *carry, "n_chunks", F.explode(parts).alias("c")).select("key", "doc_id", *carry, "n_chunks", "c.*").repartition("key", "chunk"), "chunks")
    matrices = stored(cut.select("key", "part", "begin", "end", "chunk", "n_chunks").mapInArrow(_transfer(sent), "key long, chunk int, states int, matrix binary"), "matrices")
    # a set number of partitions, which Spark doesn't merge to one task for being small
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    states = matrices.repartition(tasks, "key").groupBy("key").applyInPandas(_combine, "key long, chunk int, entry int, leave int")
    back = T.StructType([*kinds("key long", "chunk int", "n_chunks int", "doc_id long"), *kept, *kinds("ids array<int>")])
    traced = cut.join(states, ["key", "chunk"]).mapInArrow(_back(sent, list(carry)), back)
    whole = traced.groupBy("key").agg(*(F.first(c).alias(c) for c in ("doc_id", *carry, "n_chunks")), F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    whole = whole.select("doc_id", *carry, "n_chunks", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    return short.unionByName(whole.mapInArrow(*then) if then else whole)


def flat(ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a list array (null: none), and each list's offsets."""
    held = ids.flatten().to_numpy().astype(np.int64)
    sizes = ids.value_lengths().fill_null(0).to_numpy()
    return held, np.concatenate([[0], np.cumsum(sizes)])


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """The rows of encoded with their ids' text in a column ``decoded``."""
    with open(model_path or default_model(), "rb") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for batch in small(batches, 512):
            held, offsets = flat(batch.column("ids"))
            data, edges = codec.decode(held, offsets)
            try:
                str(data.data, "utf-8")
                texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
            except UnicodeDecodeError:  # ids that no text gives
                raw = data.tobytes()
                texts = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(edges, edges[1:], strict=False)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema, T.StructField("decoded", T.StringType())]))


def round_trips(docs: DataFrame, model_path: str | None = None, chunk: int = 16_384) -> DataFrame:
    """One row per row of docs: doc_id, n_chunks, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256 and round_trip.

    round_trip: the decoded text is the original (null: empty; U+2581 reads as a space).
    """
    original = F.sha2(F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(SPACE), F.lit(" ")).cast("binary"), 256)
    rows = docs.select("doc_id", "text", original.alias("original"))

    with open(model_path or default_model(), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for batch in small(batches, 256):
            held, offsets = flat(batch.column("ids"))
            data, edges = codec.decode(held, offsets)
            hashes = []
            for raw, at in ((data.tobytes(), edges.tolist()), (held.astype("<i4").tobytes(), (4 * offsets).tolist())):
                hashes.append([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)])
            decoded, ids = hashes
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("n_chunks"), pa.array(np.diff(offsets), pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()),
                    pa.array([a == b for a, b in zip(decoded, batch.column("original").to_pylist(), strict=True)], pa.bool_()),
                ],
                names=["doc_id", "n_chunks", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
            )

    schema = "doc_id long, n_chunks int, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return encode(rows, model_path, chunk, ("original",), (digest, schema))
