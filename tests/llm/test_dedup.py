import hashlib
import random

import numpy as np
import pytest

from tandem.llm.components import components
from tandem.llm.exact_dedup import exact_dedup
from tandem.llm.jaccard_join import jaccard_join
from tandem.llm.line_dedup import band_keys, line_dedup, signatures, without_lines
from tandem.llm.queries import op1_line_dedup, op3_exact_dedup, op6_jaccard_join
from tandem.llm.substring_dedup import substring_dedup

SPACES = " \t\n\x0b\x0c\r"


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}é" for _ in range(n)]


# Exact


def expected_exact(rows):
    norm = [(d, (t or ""), (t or "").translate({ord(c): None for c in SPACES})) for d, t in rows]
    out = []
    for d, _, n in norm:
        group = [(-len(t), e) for e, t, m in norm if m == n]
        keep = min(group, key=lambda x: (x[0], x[1] is None, x[1] or 0))[1]
        out.append((d, keep, len(group), d == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(5, "a b"), (1, "ab"), (2, "a\tb "), (3, None), (4, ""), (6, " \n"), (7, "x" * 5000), (8, "x" * 4999 + "y"), (9, "é a"), (10, "éa"), (11, "x" * 5000), (12, "a b")]


@pytest.mark.parametrize("options", [{"digest_all": True}, {}, {"broadcast_rows": 0}])
def test_exact(frame, options):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(frame(ROWS), **options).collect()), key=str)
    want = expected_exact(ROWS)
    if not options.get("digest_all"):
        assert [x[:4] for x in got] == [x[:4] for x in want]
    else:
        assert got == want


def test_exact_edges(frame):
    assert exact_dedup(frame([])).collect() == []
    got = exact_dedup(frame([(1, "a"), (1, "a"), (None, "a"), (None, "b")]), digest_all=True).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == [("1", "1", 3, True), ("1", "1", 3, True), ("None", "1", 3, False), ("None", "None", 1, True)]


def test_exact_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in op3_exact_dedup(spark, sf).collect()), key=str)
    assert got == expected_exact(rows)


# Substrings


def expected_substrings(rows, n):
    first, out = {}, {}
    held = {d: (t or "").encode().split() for d, t in rows}
    for d, w in held.items():
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, d), d)
    for d, w in held.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings(frame):
    passage, other = words(70, 1), words(49, 2)
    rows = [
        (3, " ".join(passage)), (1, " ".join(words(30, 3) + passage + words(9, 4))), (2, "\t".join(words(5, 5) + passage[10:65] + passage[:52])),
        (4, " ".join(other)), (5, " ".join(other)), (6, None), (7, ""), (8, " ".join(["same"] * 130)), (9, " ".join(["same"] * 51)),
        (10, " ".join(passage + passage)), (11, " ".join(words(3000, 6) + passage + words(3000, 7))), (12, "\x00 \x85a" + " ".join(passage)),
    ]
    for bits in (26, 17):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(frame(rows).repartition(4), filter_bits=bits).collect()}
        assert got == expected_substrings(rows, 50)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(frame(rows), min_words=7).collect()}
    assert got == expected_substrings(rows, 7)


def test_substring_edges(frame):
    assert substring_dedup(frame([])).collect() == []
    text = " ".join(words(60, 8))
    got = substring_dedup(frame([(2, text), (2, text), (1, text), (None, text)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 0), ("2", 60), ("2", 60), ("None", 0)]


# Near duplicates


def shingles(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(sets, least=0.8):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = {d: 0 for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                links[a] += sets[a] != sets[b]
                links[b] += sets[a] != sets[b]
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}, links


def test_jaccard(frame):
    base = words(200, 9)
    chain = [base]
    for i in range(6):  # each near the one before, the first and the last far apart
        chain.append(chain[-1][: 20 * i] + ["new%d" % i] + chain[-1][20 * i + 1 :] + words(6, 50 + i))
    rows = [(10 + i, " ".join(w)) for i, w in enumerate(chain)] + [(i, " ".join(words(150, 100 + i))) for i in range(5)]
    rows += [(30, None), (31, ""), (32, "one two"), (33, "one  two"), (34, "one two three"), (35, " ".join(base)), (36, " ".join(words(8000, 11))), (37, " ".join(words(8000, 11)[100:]))]
    want, _ = groups({d: shingles(t) for d, t in rows})
    got = jaccard_join(frame(rows).repartition(3)).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert all((r.n_links > 0) == (r.doc_id in {10, 11, 12, 13, 14, 15, 16, 35, 36, 37}) for r in got)


def test_jaccard_hot_group(frame):
    """One large group of near copies, with buckets far above the limit and dealt out in parts."""
    base = words(120, 12)
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(150) for k in [i % 120]] + [(1000 + i, " ".join(words(60, 900 + i))) for i in range(50)]
    got = jaccard_join(frame(rows), limit=8, depth=2).collect()
    want, _ = groups({d: shingles(t) for d, t in rows})
    assert {r.doc_id: r.class_id for r in got} == want


def edited(base, *places):
    """The text with these words replaced; each replaced word costs five shingles."""
    return " ".join(f"{w}x{i}" if i in places else w for i, w in enumerate(base))


def bridges(n):
    """Families of two clusters of near copies, linked by a single pair that is no cluster's centre."""
    out = []
    for s in range(n):
        base = words(240, 700 + s, 10**6)
        p, q = (10,), (20, 30, 40, 50, 60, 70)  # centres: 7 places apart; the pair (x, y) 5
        texts = [edited(base, *p), edited(base), edited(base, *q[:5]), edited(base, *q)]
        texts += [edited(base, *c, 80 + 10 * i + 5 * (c == q)) for c in (p, q) for i in range(5)]
        out += [(100 * s + i, t) for i, t in enumerate(texts)]
    return out


def test_jaccard_link_counts(frame):
    """n_links counts the other sets that a document's set is linked to, whatever the limit and the copies."""
    base = words(120, 21)
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(40) for k in [3 * i]]
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(200 + i, " ".join(words(80, 300 + i))) for i in range(10)]
    want, _ = groups({d: shingles(t) for d, t in rows})
    distinct = {shingles(t) for _, t in rows}
    links = {d: sum(s != shingles(t) and len(s & shingles(t)) >= 0.8 * len(s | shingles(t)) for s in distinct) for d, t in rows}
    for limit in (4096, 10):
        got = jaccard_join(frame(rows), limit=limit).collect()
        assert {r.doc_id: r.class_id for r in got} == want and {r.doc_id: r.n_links for r in got} == links


def test_jaccard_contained(frame):
    """A hot group above the limit in which texts contain one another."""
    base = words(200, 22, 10**6)
    rows = [(i, " ".join(base[: 164 + i] + [f"y{i}" for _ in range(i % 3)])) for i in range(37)] + [(100 + i, " ".join(base[:60] + words(120, 400 + i, 10**6))) for i in range(30)]
    want, _ = groups({d: shingles(t) for d, t in rows})
    assert {r.doc_id: r.class_id for r in jaccard_join(frame(rows), limit=6).collect()} == want


def test_repeated_ids(frame):
    """Rows of one id with different texts: each has its own lines; the id stands in a group with each of its texts."""
    a, b, c = (" ".join(words(60, 500 + i)) for i in range(3))
    rows = [(1, a), (2, f"{b}\n{b}\n{a}"), (2, "short text only"), (3, b), (3, c), (4, c)]
    got = sorted((r.doc_id, r.n_lines, r.removed) for r in line_dedup(frame(rows)).collect())
    assert got == [(1, 1, []), (2, 1, []), (2, 3, [1, 2]), (3, 1, []), (3, 1, [0]), (4, 1, [0])]
    rows = [(1, a), (2, f"{c} {a}"), (2, "short text only"), (2, a + " more"), (3, f"{c} {c}")]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(frame(rows)).collect())
    assert got == [(1, 60, 0), (2, 3, 0), (2, 61, 60), (2, 120, 60), (3, 120, 120)]
    got = sorted((r.doc_id, r.class_id) for r in jaccard_join(frame([(1, a), (2, b), (2, c), (3, b), (4, c + " x")])).collect())
    assert got == [(1, 1), (2, 2), (2, 2), (3, 2), (4, 2)]


def test_jaccard_small_and_big(frame):
    """A pair that meets in a small bucket and, without being compared there, in big ones."""
    rows = bridges(10)
    want, _ = groups({d: shingles(t) for d, t in rows})
    assert {r.doc_id: r.class_id for r in jaccard_join(frame(rows), limit=13, depth=1, runs=40).collect()} == want


def test_jaccard_beside_pivots(frame):
    """A link between two members of big buckets alone, each near a pivot that the other is not linked to."""
    rows = bridges(10)
    want, _ = groups({d: shingles(t) for d, t in rows})
    assert {r.doc_id: r.class_id for r in jaccard_join(frame(rows), limit=3, depth=1).collect()} == want


def test_jaccard_parts(frame):
    """Chains of texts, each near the next ones alone, in buckets that are all dealt out in parts."""
    texts = [words(104 + 11 * 60, s, 10**6) for s in range(4)]
    rows = [(100 * s + i, " ".join(w[11 * i : 11 * i + 104])) for s, w in enumerate(texts) for i in range(60)]
    want, _ = groups({d: shingles(t) for d, t in rows})
    assert {r.doc_id: r.class_id for r in jaccard_join(frame(rows), limit=4, depth=2).collect()} == want


def test_jaccard_edges(frame):
    assert jaccard_join(frame([])).collect() == []
    got = jaccard_join(frame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)])).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == [("1", "1", 0), ("1", "1", 0), ("2", "2", 0), ("None", "None", 0)]


def test_jaccard_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want, _ = groups({r.doc_id: shingles(r.text) for r in rows})
    got = {r.doc_id: r.class_id for r in op6_jaccard_join(spark, sf).collect()}
    linked = [d for d in want if want[d] != d]
    assert sum(got[d] == want[d] for d in linked) >= 0.97 * len(linked) > 0
    assert all(got[d] == d for d in want if want[d] == d and d not in want.values())
    sets = {d: shingles(t) for d, t in ((r.doc_id, r.text) for r in rows)}
    distinct = {s for d, s in sets.items() if got[d] != d or d in [want[x] for x in linked]}
    links = {r.doc_id: r.n_links for r in op6_jaccard_join(spark, sf).collect()}
    for d in linked[:: max(1, len(linked) // 100)]:
        assert links[d] == sum(s != sets[d] and len(s & sets[d]) >= 0.8 * len(s | sets[d]) for s in distinct)


# Lines


def line_set(line):
    raw = line.encode()
    return frozenset(raw[i : i + 8] for i in range(max(1, len(raw) - 7)) if raw[i] & 0xC0 != 0x80)


def expected_lines(rows):
    place = [(d, i, x) for d, t in rows for i, x in enumerate((t or "").split("\n")) if x.strip(SPACES)]
    distinct = sorted({x for _, _, x in place})
    roots, _ = groups({i: line_set(x) for i, x in enumerate(distinct)})
    at = {x: roots[i] for i, x in enumerate(distinct)}
    out, first = {d: (len((t or "").split("\n")), []) for d, t in rows}, {}
    for d, i, x in sorted(place):
        if first.setdefault(at[x], (d, i)) != (d, i):
            out[d][1].append(i)
    return out


def test_lines(frame, spark):
    long = " ".join(words(40, 13))
    rows = [(2, f"{long}\n\nshort\n{long} more"), (1, long.replace("w1", "w2", 1)), (3, "short\nother é line\n  \n" + long[5:]), (4, None), (5, ""), (6, "\n"), (7, "x\nx\nx"), (8, "ab"), (9, "\n".join(words(3000, 14, 90))), (10, "again " * 20 + "\n" + "again " * 50)]
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup(frame(rows).repartition(3)).collect()}
    assert got == expected_lines(rows)
    cut = {r.doc_id: r.text for r in without_lines(frame(rows), line_dedup(frame(rows))).collect()}
    assert cut[3] == "other é line\n  " and cut[7] == "x" and cut[4] is None and cut[6] == "\n"
    assert line_dedup(frame([])).collect() == []
    got = line_dedup(frame([(1, "a"), (1, "a"), (None, "a")])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 0), ("1", 0), ("None", 0)]


def test_line_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("length(text) < 400").collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected_lines(rows)
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup(frame).collect()}
    removed = lambda x: {(d, i) for d, (_, gone) in x.items() for i in gone}
    assert len(removed(got) & removed(want)) >= 0.97 * len(removed(want)) > 0 and not removed(got) - removed(want)
    assert op1_line_dedup(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_lines_hot_bucket(frame):
    """Many groups of near copies of one line, in buckets that are all dealt out in parts."""
    rng, rows = random.Random(23), []
    base = " ".join(words(12, 24))
    for family in range(8):
        centre = list(base)
        for k in range(5, 60, 9):
            centre[k + family % 3] = "abcdefgh"[family]
        for i in range(12):
            line = list(centre)
            line[rng.randrange(len(line))] = chr(0x3B1 + i)
            rows.append((len(rows), "".join(line)))
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup(frame(rows), share=10).collect()}
    assert got == expected_lines(rows)


def line_sets(size, n=4000):
    """Both sides of n pairs of sets: of size shingles one side lacks a fifth, at similarity 0.8."""
    rng = np.random.default_rng(size)
    whole = rng.integers(0, 2**64, (n, size), np.uint64)
    part = whole[:, : -(-4 * size // 5)]
    return [(np.ascontiguousarray(x).reshape(-1), np.arange(n + 1) * x.shape[1]) for x in (whole, part)]


@pytest.mark.parametrize("size", [10, 20, 40, 60, 100, 125, 150, 200, 1000])
def test_line_band_recall(size):
    """At every length pairs at the threshold share a band with the probability of independent bands."""
    sides = []
    for tokens, begin in line_sets(size):
        keys, filled = signatures(tokens, begin, 12, 5)
        keys, edge = band_keys(tokens, begin, filled, keys, 5)
        sides.append([set(keys[a:b].tolist()) for a, b in zip(edge[:-1], edge[1:], strict=True)])
    assert np.mean([bool(x & y) for x, y in zip(*sides, strict=True)]) >= 0.98


def test_components(spark):
    rng = random.Random(15)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 200)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)] + [(7, 7)]
    want, _ = {}, None
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in root if any((a == x) != (b == x) for a, b in edges)}
    for task_edges in (1_000_000, 40):
        got = components(spark.createDataFrame(edges, "u long, v long").repartition(9), task_edges=task_edges).collect()
        assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
