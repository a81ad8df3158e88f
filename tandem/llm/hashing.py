"""Vectorised text hashing over Arrow buffers, shared by the operators of this subpackage.

All functions work on the raw UTF-8 bytes of an Arrow string column, many
documents at once: words, lines and shingles are cut and hashed by numpy
passes over the bytes, never by a Python loop over words.

A hash is a polynomial in a fixed odd base modulo 2**64 (so that a window's
hash follows from two prefix sums), put through a bit mixer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
BLOCK_BYTES = 1 << 21

#: Bytes between words when a word is ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between words when a word is ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text with A-Z in lower case.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:0x80] = True
NON_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
LINE_END = np.zeros(256, bool)
LINE_END[0x0A] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASES[0]) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i from 0 to n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        have = tuple(
            np.multiply.accumulate(np.concatenate([[U64(1)], np.full(size - 1, b, U64)]))
            for b in (base, pow(base, -1, 1 << 64))
        )
        if size <= BLOCK_BYTES + 16:  # workers live on and keep this
            _powers[base] = have
    return have


def release() -> None:
    """Give freed memory back to the system: Python workers wait idle between stages and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (a 64-bit finaliser)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted (by a plain sort, which is far faster on mostly different hashes than a hash table)."""
    values = np.sort(values)
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    return values[fresh]


def prefix_sums(values: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """``P[i] = sum(values[j] * base**j for j < i)``, one longer than values."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values), base)[0][: len(values)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Hash of ``values[start:end]`` for each span, the same wherever the span stands."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), base)[1][starts])


def text_blocks(
    batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches into runs of rows of about max_bytes of text (one row at least).

    Yields the rows, the bytes of their texts (null: empty) and the texts'
    offsets in these bytes.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
    release()


def cut(data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that are not in ``between``, never across texts.

    Returns their starts, their ends and, for each text, the number of the
    first run at or after its start (with the total at the end).
    """
    inside = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes."""
    if not len(starts):
        return np.zeros(0, U64)
    return span_hashes(prefix_sums(data.astype(U64) + U64(1)), starts, ends)


def owners(first: np.ndarray) -> np.ndarray:
    """The number of the text that each run belongs to, from the third result of cut()."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
