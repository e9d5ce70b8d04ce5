from collections import Counter

import corpus_pipeline
from folioscope.llm.common import documents, staged

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage against what a plain reading of its input says."""
    from test_near_unique import plain_kept

    docs = documents(spark, SF)
    columns = docs.columns
    by = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = staged(stage(spark, docs, SF), "test")
        by[name] = (before, docs.collect())
        assert name == "sharding" or docs.columns == columns
    before, after = by["language_id"]
    assert len(after) >= 0.97 * len(before) and {r.doc_id for r in after} <= {r.doc_id for r in before}
    before, after = by["simhash_near_dedup"]
    before = sorted(before, key=lambda r: r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(before[i].doc_id for i in plain_kept([r.text for r in before]))
    before, after = by["benchmark_decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in after}
    assert not any(t in r.text for r in after for t in items)
    assert all(any(t in r.text for t in items) for r in before if r.doc_id not in kept)
    before, after = by["mix_sources"]
    words = {r.doc_id: Counter(r.text.split()) for r in before}
    assert all(set(Counter(r.text.split())) <= set(words[r.doc_id]) for r in after)
    assert max(Counter(r.doc_id for r in after).values()) <= 3
    total = sum(sum(w.values()) for w in words.values())
    assert abs(sum(len(r.text.split()) for r in after) - total) < 0.05 * total
    before, after = by["sharding"]
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == Counter(r.doc_id for r in after)
