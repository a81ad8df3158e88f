import numpy as np
import pyarrow as pa

from tandem.llm.elias_fano import EliasFano, encode
from tandem.llm.fm_index import Bits, FMIndex, Wavelet
from tandem.llm.hashing import LOWER, NON_ALNUM, SPACE, cut, prefix_sums, span_hashes, text_blocks, word_hashes


def test_cut_never_joins_texts():
    texts = ["ab cd", "", None, "ef", "\n\tgh é\x0b"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    found = []
    for rows, data, offsets in text_blocks([batch.slice(0, 0), batch], "text", 3):
        starts, ends, first = cut(data, offsets, SPACE)
        assert first[-1] == len(starts) and len(first) == rows.num_rows + 1
        found += [data.tobytes()[a:b].decode() for a, b in zip(starts, ends, strict=True)]
    assert found == ["ab", "cd", "ef", "gh", "é"]


def test_alnum_words():
    data = LOWER[np.frombuffer("Ab-C9_dÉ!".encode(), np.uint8)]
    starts, ends, _ = cut(data, np.array([0, len(data)]), NON_ALNUM)
    assert [data.tobytes()[a:b].decode() for a, b in zip(starts, ends, strict=True)] == ["ab", "c9", "dÉ"]


def test_equal_spans_hash_equal():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 5, 3000).astype(np.uint64)
    starts = np.arange(2990)
    hashes = span_hashes(prefix_sums(values), starts, starts + 10)
    seen = {}
    for i, h in enumerate(hashes.tolist()):
        assert seen.setdefault(values[i : i + 10].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)
    data = np.frombuffer(b"abc ab abc", np.uint8)
    a, b, c = word_hashes(data, np.array([0, 4, 7]), np.array([3, 6, 10]))
    assert a == c != b


def test_elias_fano_pair_and_large_parts():
    """Values with their followers, also over long gaps; ranges of one upper part that hold thousands of values."""
    rng = np.random.default_rng(9)
    dense, far = np.arange(5_000, dtype=np.uint64) * np.uint64(3), np.array([1 << 40, (1 << 40) + 1, 1 << 41], np.uint64)
    for values in (np.concatenate([dense, far]), np.sort(rng.integers(0, 700, 40).astype(np.uint64)), np.repeat(np.uint64(5), 300)):
        ef = EliasFano(encode(values, "x"), "x")
        at = np.arange(len(values) - 1)
        first, second = ef.pair(at)
        assert np.array_equal(first, values[:-1]) and np.array_equal(second, values[1:])
        asked = np.unique(np.concatenate([values, values + np.uint64(1), rng.integers(0, 1 << 42, 100).astype(np.uint64)]))
        assert np.array_equal(ef.find(asked), np.searchsorted(values, asked))


def test_elias_fano():
    rng = np.random.default_rng(2)
    for values in (np.array([], int), np.array([0, 0, 0]), np.array([5]), np.sort(rng.integers(0, 1 << 40, 2000)), np.repeat(np.arange(50), 40), np.concatenate([np.arange(1000), [1 << 50]])):
        ef = EliasFano(encode(values, "x"), "x")
        assert np.array_equal(ef.all(), values)
        if len(values):
            at = rng.integers(0, len(values), 300)
            assert np.array_equal(ef.get(at), values[at])
            ask = np.concatenate([values, values + 1, rng.integers(0, int(values[-1]) + 5, 300)])
            assert np.array_equal(ef.find(ask), np.searchsorted(values, ask))


def test_bits_and_wavelet():
    rng = np.random.default_rng(3)
    flags = rng.random(1000) < 0.3
    at = np.arange(1001)
    assert np.array_equal(Bits(flags).rank(at), np.concatenate([[0], np.cumsum(flags)]))
    symbols = rng.integers(0, 11, 500)
    tree = Wavelet(symbols, 11)
    assert np.array_equal(tree.access(np.arange(500)), symbols)
    for c in range(11):
        assert np.array_equal(tree.rank(np.full(501, c), np.arange(501)), np.concatenate([[0], np.cumsum(symbols == c)]))


def test_fm_index():
    rng = np.random.default_rng(4)
    symbols = rng.integers(0, 4, 800)
    symbols[-1] = 0
    index = FMIndex(symbols, 4)
    patterns = rng.integers(1, 4, (60, 5))
    lengths = rng.integers(1, 6, 60)
    low, high = index.search(patterns, lengths)
    for pattern, n, a, b in zip(patterns, lengths, low, high, strict=True):
        want = [i for i in range(len(symbols) - n + 1) if np.array_equal(symbols[i : i + n], pattern[5 - n :])]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want
