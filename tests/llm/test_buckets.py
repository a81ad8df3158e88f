import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.llm.buckets import Bucket, cells, compared, degrees, hopeful_members, parts, signatures
from tandem.llm.components import components
from tandem.llm.jaccard_join import _sets


def families(seed, n_families, size, edits, shared=0):
    """Families of sets near a centre, some members just under the threshold; shared hashes in all sets."""
    rng = random.Random(seed)
    out = []
    common = [rng.randrange(2**32) for _ in range(shared)]
    for _ in range(n_families):
        base = [rng.randrange(2**32) for _ in range(40)]
        for _ in range(size):
            own = list(base)
            for k in rng.sample(range(40), rng.randrange(edits + 1)):
                own[k] = rng.choice([rng.randrange(2**32), base[k] ^ 1])
            out.append(np.unique(np.array(own + common, np.uint32)))
    rng.shuffle(out)
    return out


def brute(sets, groups=None):
    """The group of each set after all links, and the number of links of each."""
    label = list(range(len(sets))) if groups is None else list(groups)
    whole = [set(s.tolist()) for s in sets]
    links = [0] * len(sets)
    for i in range(len(sets)):
        for j in range(i):
            if whole[i] and len(whole[i] & whole[j]) >= 0.8 * len(whole[i] | whole[j]):
                links[i] += 1
                links[j] += 1
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    return label, links


def same(x, y):
    return len(set(zip(x, y, strict=True))) == len(set(x)) == len(set(y))


CASES = [(1, 6, 20, 6, 0), (2, 1, 120, 9, 0), (3, 40, 3, 4, 15), (4, 3, 40, 8, 60), (5, 60, 1, 0, 30), (6, 2, 60, 5, 0)]


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("table_bits", [1 << 28, 0])
def test_bucket(case, table_bits):
    sets = [*families(*case), np.zeros(0, np.uint32)]
    n = len(sets)
    want, links = brute(sets)
    bucket = Bucket(sets, np.arange(n), 0.8, table_bits)
    found = bucket.linked()
    assert len(found) <= n - 1
    label = list(range(n))
    whole = [set(s.tolist()) for s in sets]
    for a, b in found:
        assert len(whole[a] & whole[b]) >= 0.8 * len(whole[a] | whole[b])
        label = [label[a] if x == label[b] else x for x in label]
    assert same(label, want)
    none = np.full(n, -1)
    assert Bucket(sets, np.arange(n), 0.8, table_bits).degrees(none).tolist() == links
    groups = np.random.default_rng(case[0]).integers(0, 4, n)
    label = groups.tolist()
    for a, b in Bucket(sets, groups, 0.8, table_bits).linked():
        label = [label[a] if x == label[b] else x for x in label]
    assert same(label, brute(sets, groups)[0])


@pytest.mark.parametrize("size", [5, 12, 30, 100, 300, 3000])
def test_hopeful(size):
    """A linked pair is never left out at any size; unlike sets nearly always are."""
    rng = np.random.default_rng(size)
    kept = {"linked": 0, "contained": 0, "unlike": 0}
    n, one = 300, -(-size // 9)
    for _ in range(n):
        whole = rng.integers(0, 2**32, 3 * size, np.uint32)
        for name, a, b in (("linked", whole[: size], whole[one // 2 : size + one // 2]), ("contained", whole[:size], whole[: -(-4 * size // 5)]), ("unlike", whole[:size], whole[size - 1 : 2 * size - 1])):
            alike = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            sign = signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            good = hopeful_members(sign, np.arange(2), 0.8).all()
            kept[name] += good or (name == "linked" and alike < 0.8)
    assert kept["linked"] == kept["contained"] == n and (size < 30 or kept["unlike"] < 0.05 * n)


def frame_of(spark, sets):
    return spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "item long, tokens binary")


@pytest.mark.parametrize("records", ["7", "10000"])
def test_parts_and_cells(spark, records):
    """One bucket of many groups, dealt out in parts, at two sizes of Arrow batches: brute force's groups."""
    sets = families(9, 12, 14, 6, 5) + families(10, 1, 60, 8, 5) + families(11, 70, 1, 0, 30)
    want, links = brute(sets)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        payload = frame_of(spark, sets)
        rows = payload.select(F.lit(5).cast("long").alias("bucket"), "item", F.lit(len(sets)).alias("n"), F.lit(0).cast("long").alias("pivot"))
        dealt = parts(rows, 30)
        assert dealt.groupBy("bucket").count().agg(F.max("count")).first()[0] < 60
        edges = compared(dealt.join(payload, "item").withColumn("label", F.col("item")), _sets, 0.8).select(F.col("a").alias("u"), F.col("b").alias("v"))
        groups = components(edges)
        labelled = rows.join(groups.withColumnRenamed("node", "item"), "item", "left").select("bucket", "item", F.coalesce("component", "item").alias("label"))
        more = compared(cells(labelled, 30).join(payload, "item"), _sets, 0.8).select(F.col("a").alias("u"), F.col("b").alias("v"))
        groups = components(edges.union(more))
        found = {r.node: r.component for r in groups.collect()}
        assert same([found.get(i, i) for i in range(len(sets))], want)
        counted = {r.item: r.n for r in degrees(groups.withColumnRenamed("node", "item"), lambda x: x.join(payload, "item"), _sets, 0.8, 16).collect()}
        assert [counted.get(i, 0) for i in range(len(sets))] == links
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cells_of_one_group(spark):
    rows = spark.createDataFrame([(1, i, 7) for i in range(50)] + [(2, i, i % 2) for i in range(3)], "bucket long, item long, label long")
    assert {(r.item, r.label) for r in cells(rows, 4).collect()} == {(0, 0), (1, 1), (2, 0)}
