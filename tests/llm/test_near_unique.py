import numpy as np
import pytest
from test_dedup_shard_simhash import docs

import corpus_pipeline
from folioscope.llm.common import documents
from folioscope.llm.simhash import near_unique

SF = "/root/testdata/sf0.001"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def plain_kept(texts, similarity=0.8, width=5):
    """The first text of each component of pairs at Jaccard similarity >= `similarity`, by all pairs."""
    words = [(t or "").encode().translate(LOWER).split() for t in texts]
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in words]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for j in range(len(texts)):
        for i in range(j):
            same = len(sets[i] & sets[j])
            if sets[i] == sets[j] or same / (len(sets[i]) + len(sets[j]) - same) >= similarity:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return sorted({root(i) for i in range(len(texts))})


def made(rng):
    texts = [None, "", " \n", "The", "the", "one two three four", "one two three FOUR", "one two three four five"]
    line = " ".join(f"line{k}" for k in range(30))
    for n in (6, 20, 60, 150, 400):
        for base in range(4):
            words = [f"w{x}" for x in rng.integers(0, 5000, n)]
            for k in range(9):
                # Up to n / 30 words are changed: similarities lie on either side of 0.8.
                copy = list(words)
                for at in rng.integers(0, n, rng.integers(0, 2 + n // 30)):
                    copy[at] = f"new{rng.integers(0, 10**6)}"
                texts.append(" ".join(copy) + (f" {line}" if base % 2 else ""))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_near_unique_against_all_pairs(spark, seed):
    texts = made(np.random.default_rng(seed))
    kept = sorted(r.doc_id for r in near_unique(docs(spark, texts).repartition(4)).collect())
    assert kept == plain_kept(texts)
    assert 20 < len(kept) < len(texts) - 40


def test_exactly_at_the_limit(spark):
    base = [f"w{k}" for k in range(49)]  # 45 shingles; with five more words behind 50, without nine 36
    texts = [" ".join(base), " ".join(base[:40]), " ".join(base[:39])]
    assert plain_kept(texts[:2]) == [0] and plain_kept(texts[::2]) == [0, 1]
    assert [r.doc_id for r in near_unique(docs(spark, texts[:2])).collect()] == [0]
    assert sorted(r.doc_id for r in near_unique(docs(spark, texts[::2])).collect()) == [0, 1]


def test_repeated_and_null_ids(spark):
    texts = ["a b c d e f", "A b c d e f", "x", "y y", None]
    rows = near_unique(docs(spark, texts, [None, 4, 4, 4, None])).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in rows) == [(-1, ""), (4, "A b c d e f"), (4, "x"), (4, "y y")]
    assert near_unique(docs(spark, [])).count() == 0


def test_stage_of_the_pipeline(spark):
    rows = documents(spark, SF)
    texts = {r.doc_id: r.text for r in rows.collect()}
    ids = sorted(texts)
    got = sorted(r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, rows, SF).collect())
    assert got == [ids[i] for i in plain_kept([texts[i] for i in ids])]
