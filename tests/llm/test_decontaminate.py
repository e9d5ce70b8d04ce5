import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm.decontaminate import Finder, Items, decontaminated, distance, edits_allowed, find_leaks, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, contaminated string"
RNG = np.random.default_rng(8)
VOCABULARY = np.array([f"{a}{b}" for a in "the of in that was on he it for with".split() for b in ["", "er", "ing", "ed", "ly"]] + [f"w{i}" for i in range(300)])


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY, n))


def edited(text, edits, rng):
    words = text.split()
    for _ in range(edits):
        at, kind = int(rng.integers(len(words))), rng.integers(3)
        words[at : at + (kind != 0)] = [] if kind == 1 else [f"new{rng.integers(10**6)}"]
    return " ".join(words)


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, v in enumerate(text):
            new.append(min(row[j] + (w != v), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(30))
def test_distance(seed):
    rng = np.random.default_rng(seed)
    item, text = rng.integers(0, 6, rng.integers(1, 90)).astype(np.uint64), rng.integers(0, 6, rng.integers(0, 120)).astype(np.uint64)
    assert distance(item, text) == plain_distance(item.tolist(), text.tolist())


def brute(texts, items, similarity=0.8, least=5):
    out = []
    for t in texts:
        w = words_of(pa.array([t or ""]))[0].tolist()
        hits = []
        for i, x in items:
            v = words_of(pa.array([x or ""]))[0].tolist()
            if len(v) >= least and i is not None and plain_distance(v, w) <= edits_allowed(len(v), similarity):
                hits.append(i)
        out.append(sorted(set(hits)))
    return out


def test_find_leaks(spark):
    rng = np.random.default_rng(4)
    items = [(i, prose(int(rng.integers(5, 60)), rng)) for i in range(40)] + [(100, "too short"), (101, None), (None, prose(20, rng)), (102, "")]
    items += [(103, items[3][1].upper() + "!")]
    texts = [None, "", "the", *(prose(int(rng.integers(10, 300)), rng) for _ in range(60))]
    for k in range(120):
        item = items[k % 40][1]
        n = len(item.split())
        texts.append(" ".join([prose(int(rng.integers(0, 60)), rng), edited(item, int(rng.integers(0, edits_allowed(n, 0.8) + 1)), rng), prose(int(rng.integers(0, 60)), rng)]))
    texts += [edited(items[k][1], 1, rng) for k in range(8)] + [prose(20_000, rng) + " " + items[5][1]] + [items[7][1]] * 5
    docs = spark.createDataFrame([(i, t, None, None, None, 1, "x") for i, t in enumerate(texts)], SCHEMA)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in find_leaks(docs.repartition(4), benchmark).collect()}
    want = brute([t for t in texts if len(t or "") < 50_000], items)
    wanted = sum(map(len, want))
    short = [i for i, t in enumerate(texts) if len(t or "") < 50_000]
    found = 0
    for i, w in zip(short, want):
        assert set(got[i].item_ids) <= set(w) and got[i].contaminated == bool(got[i].item_ids) and got[i].n_items == len(got[i].item_ids)
        found += len(got[i].item_ids)
    assert wanted > 130 and found >= 0.97 * wanted
    assert {3, 103} <= set(next(got[i].item_ids for i, w in zip(short, want) if 3 in w))
    assert all(got[len(texts) - 1 - k].item_ids == [7] for k in range(5)) and 5 in got[len(texts) - 6].item_ids
    blocks = find_leaks(docs, benchmark, block_bytes=2000)
    assert {r.doc_id: r.item_ids for r in blocks.collect()} == {k: r.item_ids for k, r in got.items()}
    kept = decontaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, r in got.items() if not r.contaminated)


def test_recall_at_the_limit():
    rng = np.random.default_rng(11)
    items = [prose(int(n), rng) for n in rng.integers(15, 70, 60)]
    finder = Finder(Items.of(list(range(60)), items, 0.8, 5, 0.97))
    texts, wanted = [], []
    for k in range(300):
        item = items[k % 60]
        n = len(item.split())
        body = edited(item, edits_allowed(n, 0.8), rng)
        texts.append(" ".join([prose(30, rng), body, prose(30, rng)]))
        wanted.append(k % 60)
    found = finder.find(pa.array(texts))
    assert np.mean([w in {k for k, _ in f} for w, f in zip(wanted, found)]) > 0.95


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", None, None, None, 1, "x"), (None, None, None, None, None, None, None)], SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in find_leaks(docs, none).collect()] == [False, False]
    assert find_leaks(docs.where("false"), none).count() == 0
    assert decontaminated(docs, none).count() == 2


def test_recall_is_measured_for_each_length(monkeypatch):
    from folioscope.llm import decontaminate
    from folioscope.llm.decontaminate import walks_for

    for n in [*range(1, 31), 45, 80, 150]:
        walks, recall = walks_for(n, 0.8, 0.97)
        assert recall >= 0.97 and (recall == 1.0 or n >= 5)
    monkeypatch.setattr(decontaminate, "MOST_WALKS", 1)
    with pytest.raises(ValueError, match="walks find"):
        walks_for(60, 0.7, 0.99)


def test_short_items_and_other_ids(spark):
    items = [("one", "zeppelin"), ("two", "red zeppelin"), ("four", "a red zeppelin landed"), ("long", "x")]
    texts = ["The red, zeppelin!", "zeppelin", "A red zeppelin landed here", "red and zeppelin", "nothing", None]
    docs = spark.createDataFrame([(f"d{i}", t, None, None, None, 1, "x") for i, t in enumerate(texts)], SCHEMA.replace("doc_id long", "doc_id string"))
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r.item_ids for r in find_leaks(docs, benchmark).collect()}
    assert got == {"d0": ["one", "two"], "d1": ["one"], "d2": ["four", "one", "two"], "d3": ["one"], "d4": [], "d5": []}
    got = {r.doc_id: r.item_ids for r in find_leaks(docs, benchmark, least_words=4).collect()}
    assert got == {"d0": [], "d1": [], "d2": ["four"], "d3": [], "d4": [], "d5": []}
