import hashlib
import random
import re

import numpy as np
import pytest

from tandem.llm.decontamination import decontaminate
from tandem.llm.queries import op8_decontamination, op10_sentencepiece
from tandem.llm.sentencepiece_codec import SPACE, Codec, Chunk, decode, default_model, encode, product, round_trips, scan

UPPER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall((text or "").translate(UPPER))


def expected(docs, items, window=10):
    phrases = {}
    for name, text in items:
        w = cut(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            phrases.setdefault(tuple(w[i : i + n]), set()).add("" if name is None else str(name))
    out = {}
    for d, text in docs:
        w, hit, held = cut(text), set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                if found := phrases.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    held |= found
        out[d] = (len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit))
    return out


def report(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def cases(spark):
    rng = random.Random(1)
    some = lambda n, k: [f"w{rng.randrange(k)}" for _ in range(n)]
    item, other = some(25, 50), some(14, 50)
    items = [(1, " ".join(item)), (2, "Étude Two-three"), (10, " ".join(other + item[:12])), (3, None), (4, "..."), (None, "only you")]
    docs = [
        (1, " ".join(some(30, 60) + item + some(5, 60))), (2, "an ÉTUDE? no, étude"), (3, "Étude, TWO three!"), (4, None), (5, ""), (6, " ".join(item[3:13])), (7, " ".join(item[:9] + ["x"] + item[9:])),
        (8, "-".join(item).upper() + " " + " ".join(item)), (9, " ".join(some(5000, 50) + other + some(5000, 50))), (11, "only you"), (12, "\x00" + " ".join(item[5:16]) + "\x7f"),
    ]
    return docs, items, spark.createDataFrame(items, "item_id long, text string")


def test_decontaminate(frame, spark):
    docs, items, table = cases(spark)
    want = expected(docs, items)
    assert report(decontaminate(frame(docs).repartition(3), table)) == want
    assert report(decontaminate(frame(docs), table, block_words=1)) == want  # one item a round
    assert report(decontaminate(frame(docs), table, window=3)) == expected(docs, items, 3)
    assert decontaminate(frame([]), table).collect() == []
    assert all(not r.contaminated for r in decontaminate(frame(docs), table.limit(0)).collect())


def test_clean(frame, spark):
    docs, items, table = cases(spark)
    for block in (500_000, 1):
        rows = decontaminate(frame(docs), table, block_words=block, clean=True)
        assert rows.columns == frame(docs).columns
        got = {r.doc_id: r.text for r in rows.collect()}
        for d, text in docs:
            hit = expected(docs, items)[d][1]
            assert (got[d] == text) == (not hit) and len(cut(got[d])) == len(cut(text)) - hit
    assert got[3] == "!"


def test_decontaminate_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert report(op8_decontamination(spark, sf)) == expected(docs, items)


# SentencePiece

TEXTS = [
    "Hello world, this  is a   test.", "internationalization " * 30, "日本語のテキスト" * 20, "😀🎉 mixed é è\n\ttabs", "aaaa" * 60, "  lead and trail  ", "x", "▁odd▁mark", "<s> </s> <0x41>", "nospace" * 40, "\x00\x01 control",
]


@pytest.fixture(scope="module")
def codec():
    with open(default_model(), "rb") as f:
        return Codec(f.read())


def by_scan(codec, text, chunk):
    written = SPACE + text.replace(" ", SPACE)
    n = -(-len(written) // chunk)
    chunks = []
    for k in range(n):
        low = max(0, k * chunk - codec.longest)
        chunks.append(Chunk(codec, written[low : low + chunk + 2 * codec.longest], k * chunk - low, min((k + 1) * chunk, len(written)) - low, k == 0, k == n - 1))
    states = scan([c.matrix() for c in chunks])
    return np.frombuffer(b"".join(c.ids(c.entries[a], c.exits[b]) for c, a, b in zip(chunks, states, states[1:], strict=False)), np.int32).tolist()


def test_scan_equals_the_library(codec):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("abethin  é日▁\n") for _ in range(rng.randrange(1, 250))) for _ in range(60)]
    for text in texts:
        for chunk in (32, 39, 100):
            assert by_scan(codec, text, chunk) == codec.library.encode(text), (text, chunk)


def test_product_is_associative(codec):
    text = SPACE + "internationalization" * 20
    parts = []
    for k in range(8):
        low = max(0, 40 * k - codec.longest)
        parts.append(Chunk(codec, text[low : low + 40 + 2 * codec.longest], 40 * k - low, 40 * (k + 1) - low, k == 0, False).matrix())
    left, right = parts[0], parts[-1]
    for m in parts[1:]:
        left = product(left, m)
    for m in parts[-2::-1]:
        right = product(m, right)
    assert (left == right).all() and (left == 0).any()


def test_encode_and_decode(frame, codec):
    docs = [*enumerate(TEXTS), (50, None), (51, ""), (52, " ".join(TEXTS) * 40), (52, " ".join(TEXTS) * 40), (53, "z" * 3000), (None, "a b"), (54, "a "), (55, " "), (56, "  "), (57, "a\n b  "), (58, "▁"), (59, "a▁ ")]
    rows = encode(frame(docs).repartition(3), chunk=64, carry=("source", "spans")).collect()
    assert len(rows) == len(docs) and rows[0].source == "s"
    want = {d: codec.library.encode(t or "") for d, t in docs}
    assert all(r.ids == want[r.doc_id] for r in rows)
    texts = {r.doc_id: r.decoded for r in decode(encode(frame(docs), chunk=64)).collect()}
    assert all(texts[d] == (t or "").replace(SPACE, " ") for d, t in docs)
    assert all(r.round_trip for r in round_trips(frame(docs), chunk=64).collect())
    assert round_trips(frame([])).collect() == []
    with pytest.raises(ValueError):
        encode(frame([]), chunk=16)


def test_encode_table(spark, sf, codec):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op10_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts) and max(r.n_chunks for r in rows) > 1
    for r in rows:
        ids = codec.library.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()) and r.round_trip
