from collections import Counter

import numpy as np
import pytest

from folioscope.llm.substrings import FmIndex, WaveletTree, fragments, lowest_in_windows, remove_repeated, repeated_in_shard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, tie string, anchor int"


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def brute(texts, window):
    seen = Counter()
    lists = [words(t) for t in texts]
    for w in lists:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_rank():
    rng = np.random.default_rng(0)
    for alphabet in (2, 3, 17, 200):
        symbols = rng.integers(0, alphabet, 500)
        tree = WaveletTree(symbols, alphabet)
        c, end = rng.integers(0, alphabet, 300), rng.integers(0, 501, 300)
        assert tree.rank(c, end).tolist() == [(symbols[:e] == x).sum() for x, e in zip(c, end)]


@pytest.mark.parametrize("seed", range(5))
def test_matching_lengths(seed):
    rng = np.random.default_rng(seed)
    symbols = np.append(rng.integers(0, 4, 150), 0)
    index = FmIndex(symbols, 4)
    got = index.matching_lengths(symbols, np.arange(1, 152), 20)
    text = symbols.tolist()
    for end in range(1, 152):
        best = 0
        for n in range(1, 21):
            part = text[end - n : end] if end >= n else [0]
            if 0 in part or sum(text[i : i + n] == part for i in range(len(text))) < 2:
                break
            best = n
        assert got[end - 1] == best


def test_lowest_and_fragments():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 30, 100).astype(np.uint64)
    assert lowest_in_windows(values, 7).tolist() == [i + int(np.argmin(values[i : i + 7])) for i in range(94)]
    text, start, count, _ = fragments(rng.integers(0, 50, 300).astype(np.uint64), np.array([0, 5, 5, 120, 300]), 12, 4)
    every = sorted((t, s + k) for t, s, c in zip(text, start, count) for k in range(c))
    assert every == [(2, i) for i in range(5, 109)] + [(3, i) for i in range(120, 289)]


def test_shard():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, 60).astype(np.int64)
    lists = [base[:40], base[5:50], rng.integers(0, 2**62, 30).astype(np.int64), np.concatenate([base[:12], base[:12]])]
    seen = Counter(tuple(x[i : i + 10]) for x in lists for i in range(len(x) - 9))
    for x, again in zip(lists, repeated_in_shard(lists, 10)):
        assert again.tolist() == [seen[tuple(x[i : i + 10])] > 1 for i in range(len(x) - 9)]


def corpus():
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(2000)] + ["the", "of", "é", "\x1c"]
    prose = lambda n: list(rng.choice(vocabulary, n))
    common, rare = prose(60), prose(37)
    texts = [None, "", "short text", " \n ", " ".join(prose(35)), "x " * 34, "x " * 35, "x " * 36, "y " * 5000, "a b c " * 40]
    for k in range(80):
        t = prose(int(rng.integers(5, 200)))
        for _ in range(k % 3):
            at = int(rng.integers(len(t)))
            t[at:at] = common[int(rng.integers(0, 20)) : int(rng.integers(40, 61))]
        texts.append(("\n" if k % 2 else "  ").join(t))
    texts += [" ".join([*prose(50), *rare, *prose(3)]), " ".join([*rare, *prose(9)])]
    texts += [texts[20]] * 7
    near = texts[40].split()
    for k in range(30):
        t = list(near)
        t[int(rng.integers(len(t)))] = f"new{k}"
        texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize("split", [1, 128])
def test_remove_repeated(spark, split):
    texts = corpus()
    rows = [(i, t, None, None, None, 1, "x", 2) for i, t in enumerate(texts)]
    got = remove_repeated(spark.createDataFrame(rows, SCHEMA).repartition(4), split=split, shard_words=2000).collect()
    want = brute(texts, 35)
    assert len(got) == len(texts) and sum(w[1] for w in want) > 3000
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == dict(enumerate(want))


def test_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    texts = [text, text, text + " more", None, "other " * 3, "w " * 40]
    rows = [(i, t, None, None, None, 1, "x", 2) for i, t in zip([1, 1, 1, None, None, 2], texts)]
    got = remove_repeated(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda x: (x[0] or 0, x[1:])
    want = [(r[0], *w) for r, w in zip(rows, brute(texts, 35))]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert remove_repeated(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("window", [9, 40, 64, 80, 130])
@pytest.mark.parametrize("seed", range(8))
def test_shards_of_other_windows(window, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 3, 400).astype(np.int64)
    lists = [base[: 2 * window], base[5 : 6 + 2 * window], np.tile(base[:3], 60), np.tile(base[1:4], 50), base[window : 2 * window + 3]]
    lists += [np.concatenate([base[:window], rng.integers(0, 3, 40)]) for _ in range(4)]
    twice = [bool(x) for x in rng.integers(0, 2, len(lists))]
    seen = Counter()
    for x, t in zip(lists, twice):
        seen.update({k: n * (1 + t) for k, n in Counter(tuple(x[i : i + window]) for i in range(len(x) - window + 1)).items()})
    for x, again in zip(lists, repeated_in_shard(lists, window, twice)):
        assert again.tolist() == [seen[tuple(x[i : i + window])] > 1 for i in range(len(x) - window + 1)]


def test_the_index_refuses_longer_patterns():
    index = FmIndex(np.array([1, 2, 1, 2, 0]), 3, depth=2)
    assert index.matching_lengths(np.array([1, 2, 1, 2, 0]), np.array([4]), 2).tolist() == [2]
    with pytest.raises(ValueError, match="up to 2"):
        index.matching_lengths(np.array([1, 2, 1, 2, 0]), np.array([4]), 3)


@pytest.mark.parametrize("split", [1, 5])
def test_a_very_common_passage_goes_through_several_shards(spark, split):
    rng = np.random.default_rng(9)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for k in range(120):
        left, right = ([f"w{x}" for x in rng.integers(0, 400, 25)] for _ in range(2))
        texts.append(" ".join([*left, *passage, *right]))
        if k % 4 == 0:
            texts.append(" ".join([*left[-8:], *passage, *right[:3], f"e{k}"]))
    rows = [(i, t, None, None, None, 1, "x", 2) for i, t in enumerate(texts)]
    got = remove_repeated(spark.createDataFrame(rows, SCHEMA), split=split, shard_words=500).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == dict(enumerate(brute(texts, 35)))


def test_another_window_and_string_ids(spark):
    texts = corpus()
    rows = [(f"id{i}" if i else None, t) for i, t in enumerate(texts)]
    got = remove_repeated(spark.createDataFrame(rows, "doc_id string, text string"), window=20).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == {i: w for (i, _), w in zip(rows, brute(texts, 20))}


def test_rows_of_one_id_are_told_apart(spark):
    """Many different texts without an id."""
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{passage} own{i}" for i in range(300)]
    rows = [(None, t, None, None, None, 1, "x", 2) for t in texts] * 2
    got = remove_repeated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(r.kept for r in got) == Counter(w[2] for w in brute(texts * 2, 35))


def test_windows_that_go_on_sharing_an_anchor(spark, monkeypatch):
    """Many texts with 30 words in common: after the cuts by parts, whole windows decide, and no anchor has more than `split` contents."""
    from folioscope.llm import substrings

    monkeypatch.setattr(substrings, "LEVELS", 2)
    rng = np.random.default_rng(4)
    fixed = " ".join(f"f{k}" for k in range(30))
    texts = [f"{fixed} " + " ".join(f"t{x}" for x in rng.integers(0, 3, 9)) for _ in range(300)] + [f"other start {fixed} t1 t1 t1 t1 t1 t1 t1 t1 t1"] * 2
    rows = [(i, t, None, None, None, 1, "x", 2) for i, t in enumerate(texts)]
    got = remove_repeated(spark.createDataFrame(rows, SCHEMA), split=3, shard_words=200).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == dict(enumerate(brute(texts, 35)))
