import hashlib

from test_dedup import SPACES, groups, shingles
from test_texts import expected

import corpus_pipeline
from tandem.llm.queries import table


def test_stages(spark, sf):
    """Each stage against brute force on what the stage before kept."""
    docs = table(spark, sf, "documents")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema).repartition(4)
        kept.append({r.doc_id: r.text for r in docs.collect()})
    rated, exact, near, clean = kept
    labels = {r.doc_id: r.toxic == 0 and r.quality == 1 for r in table(spark, sf, "labels").collect()}
    good = [d for d, ok in labels.items() if ok]
    assert sum(d in rated for d in good) >= 0.97 * len(good)
    assert sum(d in rated for d, ok in labels.items() if not ok) <= 0.2 * (len(labels) - len(good))
    norm = lambda t: (t or "").translate({ord(c): None for c in SPACES})
    best = {}
    for d, t in rated.items():
        best[norm(t)] = min(best.get(norm(t), (1, 0)), (-len(t or ""), d))
    assert set(exact) == {d for _, d in best.values()}
    classes, _ = groups({d: shingles(t) for d, t in exact.items()})
    assert {d for d, c in classes.items() if c == d} <= set(near) and len(near) <= len(set(classes.values())) + 2
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    assert set(clean) == set(near)
    hits = expected(list(near.items()), items)
    assert all((clean[d] == near[d]) == (not hits[d][4]) for d in near)
    last = corpus_pipeline.STAGES[4][1](spark, docs, sf).collect()
    assert {r.doc_id for r in last} == set(clean) and all(r.round_trip for r in last)
    assert all(r.decoded_sha256 == hashlib.sha256((clean[r.doc_id] or "").replace("▁", " ").encode()).hexdigest() for r in last)


def test_run(spark, sf, tmp_path):
    assert corpus_pipeline.run(spark, sf).count() > 500
    for name in ("documents", "labels", "benchmark"):
        table(spark, sf, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
