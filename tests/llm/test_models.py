import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.llm import language_id, ngram_lm, quality_classifier
from tandem.llm.ngram_lm import lm_score, train
from tandem.llm.queries import op2_ngram_lm, op4_quality_classifier, op5_language_id

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*(text or "").encode().translate(LOWER).split(), "END"]


class Brute:
    """The same model with dictionaries."""

    def __init__(self, texts, order, prior=1.0):
        self.order, self.prior = order, prior
        self.counts = collections.Counter()
        self.grams = collections.defaultdict(collections.Counter)
        for text in texts:
            own = tokens(text)
            self.counts.update(own)
            row = ["END", *own]
            for n in range(2, order + 1):
                for i in range(n - 1, len(row)):
                    self.grams[tuple(row[i - n + 1 : i])][row[i]] += 1
        self.n, self.v = sum(self.counts.values()), len(self.counts)

    def p(self, context, word):
        if not context:
            return (self.counts[word] + 0.1) / (self.n + 0.1 * (self.v + 1))
        low = self.p(context[1:], word)
        if context not in self.grams:
            return low
        found = self.grams[context]
        return (found[word] + self.prior * len(found) * low) / (sum(found.values()) + self.prior * len(found))

    def row(self, text):
        own = tokens(text)
        row = ["END", *own]
        score = sum(math.log10(self.p(tuple(row[max(0, i - self.order + 1) : i]), row[i])) for i in range(1, len(row)))
        return len(own), sum(t in self.counts for t in own), self.n, sum(math.log10(self.p((), t)) for t in own), score


def check(got, model, texts):
    for d, text in texts.items():
        n, known, total, base, score = model.row(text)
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, abs=2e-4 * n)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm(frame, order):
    texts = {1: "The cat sat. the Cat sat", 2: "the dog\x0bran É é", 3: None, 4: "", 5: "the cat ran the cat sat the", 6: "a " * 3000}
    model = train(frame(texts.items()), order)
    asked = texts | {7: "unknown words here", 8: "the cat sat on the dog", 9: None}
    check({r.doc_id: r for r in lm_score(frame(asked.items()), model).collect()}, Brute(texts.values(), order), asked)


def test_lm_edges(frame):
    empty = train(frame([]), 2)
    r = lm_score(frame([(1, "a b")]), empty).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.score == r.base_score == pytest.approx(0)
    assert lm_score(frame([]), empty).collect() == []
    with pytest.raises(ValueError):
        train(frame([]), 0)


def test_lm_reads(frame, spark):
    """The size, the words and the n-grams of all levels: each row is read three times, whatever the order."""
    rows = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        rows.add(1)
        return text

    texts = frame([(i, f"a b c {i}") for i in range(40)]).select("doc_id", seen("text").alias("text"))
    assert train(texts, 4).words == 44 and rows.value == 3 * 40


def test_lm_joined():
    rng = np.random.default_rng(8)
    parts, pairs, triples = [], collections.Counter(), collections.Counter()
    for n in (300, 0, 1, 500):
        grams = [tuple(x) for x in rng.integers(0, 9, (n, 3)).tolist()]
        two, three = collections.Counter(x[:2] for x in grams), collections.Counter(grams)
        pairs, triples = pairs + two, triples + three
        place = {x: i for i, x in enumerate(sorted(two))}
        table = lambda x: tuple(np.array(x, np.uint32).reshape(-1, 3).T)
        parts.append([table([(*x, two[x]) for x in sorted(two)]), table([(place[x[:2]], x[2], three[x]) for x in sorted(three)])])
    two, three = ngram_lm._joined(parts)
    found = list(zip(two[0].tolist(), two[1].tolist(), strict=True))
    assert found == sorted(pairs) and two[2].tolist() == [pairs[x] for x in found]
    grams = [(*found[i], w) for i, w in zip(three[0].tolist(), three[1].tolist(), strict=True)]
    assert grams == sorted(triples) and three[2].tolist() == [triples[x] for x in grams]


def test_lm_children(frame):
    """Each pair of a context and a word, -1 (unknown) among them, is found if and only if the texts have it."""
    texts = {i: " ".join(f"w{j}" for j in np.random.default_rng(i).integers(0, 12, 9)) for i in range(6)}
    model = train(frame(texts.items()), 3)
    ways = {level: {tuple(w): i for i, w in enumerate(x for s in range(model.shards) if model.sizes[level - 1][s] for x in model.way(level, s).tolist())} for level in (2, 3)}
    for level in (2, 3):
        contexts = np.repeat(np.arange(sum(model.sizes[level - 2])), model.words + 1)
        words = np.tile(np.arange(-1, model.words), len(contexts) // (model.words + 1))
        before = [(i,) for i in range(model.words)] if level == 2 else sorted(ways[2], key=ways[2].get)
        want = [ways[level].get((w, *before[c]), -1) for c, w in zip(contexts.tolist(), words.tolist(), strict=True)]
        for some in (np.arange(len(words)), np.flatnonzero((words == -1) | (words == model.words - 1))):
            assert model.children(level, contexts[some], words[some]).tolist() == [want[i] for i in some]


def test_lm_sums_to_one(frame):
    model = train(frame([(1, "a b a c"), (2, "a b")]), 2)
    brute = Brute(["a b a c", "a b"], 2)
    mass = sum(brute.p((b"a",), w) for w in brute.counts) + brute.p((b"a",), "unknown")
    assert mass == pytest.approx(1) and model.words == 4


def test_lm_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    held = {d for d in texts if zlib.crc32(str(d).encode()) % 10 == 0}
    got = {r.doc_id: r for r in op2_ngram_lm(spark, sf).collect()}
    assert {d for d, r in got.items() if r.held_out} == held
    check(got, Brute([t for d, t in texts.items() if d not in held], 3), texts)
    n = sum(got[d].n_tokens for d in held)
    assert sum(got[d].score for d in held) / n > sum(got[d].base_score for d in held) / n


# Language


def test_language_scripts(spark):
    rows = [(i, f"the house and the garden {w} with the water", "en") for i, w in enumerate(["of", "is", "was", "has"] * 5)]
    rows += [(100 + i, f"das haus und der garten {w} mit dem wasser", "de") for i, w in enumerate(["von", "ist", "war", "hat"] * 5)]
    rows += [(200 + i, f"дом и сад {w} с водой", "ru") for i, w in enumerate(["был", "есть", "для", "под"] * 5)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(labelled)
    asked = [(1, "Der Garten und das Wasser"), (2, "the garden and the water"), (3, "САД и дом"), (4, None), (5, ""), (6, "12 %% --"), (7, "東京"), (8, "the house and the garden with the water das haus und der garten mit dem wasser und das haus")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert [got[i][0] for i in (1, 2, 3)] == ["de", "en", "ru"] and all(got[i] == ("und", 0.0) for i in (4, 5, 6))
    assert got[7][0] in model.languages and 0 < got[8][1] < 1
    spans = {r.doc_id: [(s.lang, s.words) for s in r.spans] for r in language_id.language_spans(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert spans[8] == [("en", 8), ("de", 11)] and spans[4] == []


def test_viterbi_is_exact():
    rng = np.random.default_rng(5)
    k, bits = 3, 10
    model = language_id.Model(["a", "b", "c"], rng.normal(0, 2, (1 << bits, k)).astype(np.float32), np.ones((len(language_id.NAMES), k), bool), bits, 3.0)
    texts = ["ab cde fg h ij klm no", "x", "", "qr st uv wx", "aa bb cc dd ee ff gg hh ii"]
    words, label = model.spans(texts)
    score = np.stack([np.bincount(words.gram_word, model.weights[:, j][words.gram], len(words.script)) for j in range(k)], 1)

    def value(own, path):
        return sum(own[t, j] for t, j in enumerate(path)) - 3.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))

    import itertools

    for t in range(len(texts)):
        own, path = score[words.text == t], label[words.text == t].tolist()
        if len(own):
            assert value(own, path) == pytest.approx(max(value(own, p) for p in itertools.product(range(k), repeat=len(own))))


def test_language_edges(frame, spark):
    none = language_id.fit(frame([]))
    assert [(r.lang_pred, r.score) for r in language_id.identify(frame([(1, "abc"), (None, None)]), none).collect()] == [("und", 0.0)] * 2
    assert language_id.identify(frame([]), none).collect() == []


def test_language_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").join(op5_language_id(spark, sf), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.98 and all(0 <= r.score <= 1 for r in rows)


# Quality


def test_thresholds_and_order():
    rng = np.random.default_rng(6)
    n = 1500
    kind = rng.integers(0, 3, n)
    doc = np.repeat(np.arange(n), 3)
    column = np.stack([kind, 3 + rng.integers(0, 20, n), 23 + rng.integers(0, 20, n)], 1).reshape(-1)
    grade = np.clip(kind + (rng.random(n) < 0.1), 0, 2)
    w, t = quality_classifier.cumulative_link(doc, column, grade, 43, 3)
    assert t[0] < t[1] and w[0] < w[1] < w[2] and np.abs(w[3:]).max() < w[2] - w[0]


def test_quality_edges(frame, spark):
    rated = spark.createDataFrame([(i, "good text here" if i % 2 else "awful junk ###", i % 2) for i in range(60)] + [(99, None, 1), (98, "x", None)], "doc_id long, text string, rating int")
    model = quality_classifier.fit(rated, least_docs=2)
    docs = frame([(1, "good text"), (2, "junk ###"), (3, None), (4, ""), (5, "good " * 20_000), (1, "good text"), (None, "junk")])
    rows = quality_classifier.graded(docs, model, least=1).collect()
    assert len(rows) == 7 and set(docs.columns) < set(rows[0].asDict())
    got = {r.doc_id: r for r in rows}
    assert got[1].keep and not got[2].keep and got[3].tail == got[4].tail and 0 <= got[5].expected_grade <= 1
    again = quality_classifier.fit(rated, least_docs=2)
    assert np.array_equal(model.weights, again.weights)
    none = quality_classifier.fit(rated.limit(0))
    assert all(r.keep and r.expected_grade is None for r in quality_classifier.graded(docs, none, least=1).collect())
    assert quality_classifier.graded(frame([]), model, least=1).collect() == []


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op4_quality_classifier(spark, sf).join(labels, "doc_id").filter("held_out")
    got = {(r.toxic, r.quality): (r.n, r.kept) for r in rows.groupBy("toxic", "quality").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert got[0, 1][1] >= 0.97 and got[0, 0][1] <= 0.3 and got[1, 1][1] <= 0.3
