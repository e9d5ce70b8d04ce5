"""Packing against plain tokenising, a plain search of levels, and exact reassembly."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioscope.llm import queries
from folioscope.llm.packing import Packer, Words, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
AWKWARD = ["", None, "  ", "a", "A  b\tc\n", "don't STOP'LL 12.5€", "naïve café ﬁ", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", " a b", "ΟΔΥΣΣΕΥΣ Σ", "é ́e", "日本語 テスト", "x" * 3000]


def plain_ids(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=6))
def test_words_are_tokenised_as_whole_texts(texts):
    ids, at = Words(PATH, 2)(pa.array(texts, pa.string()))
    assert [list(ids[a:b]) for a, b in zip(at, at[1:])] == plain_ids(texts)


def test_awkward_texts(monkeypatch):
    words = Words(PATH, 2)
    for most in (0, 10**9):  # with words forgotten between calls, and kept
        monkeypatch.setattr("folioscope.llm.packing.MOST_CHARS", most)
        for _ in range(2):
            ids, at = words(pa.array(AWKWARD, pa.string()))
            assert [list(ids[a:b]) for a, b in zip(at, at[1:])] == plain_ids(AWKWARD)


def check_pieces(pieces, sizes, window):
    """Every id once, sequences gapless, padding only where a length is no power of two: nowhere."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for row, start, ids, sequence, offset in pieces:
        by_doc[row].append((start, list(ids)))
        by_sequence[sequence].append((offset, len(ids)))
    for row, size in sizes.items():
        assert [i for _, ids in sorted(by_doc[row]) for i in ids] == list(range(size))
        at = 0
        for start, ids in sorted(by_doc[row]):
            assert start == at
            at += len(ids)
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= window and at & (at - 1) == 0
    return by_sequence


def plain_level(counts, size, window):
    """Every level tried, the whole sum counted each time."""
    tried = []
    for level in [0, *(h for h, n in counts.items() if n and h + size <= window)]:
        after = Counter(counts)
        if level:
            after[level] -= 1
        if level + size < window:
            after[level + size] += 1
        tried.append((sum(n * n for n in after.values()), -level))
    return -min(tried)[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.sampled_from([16, 32]), st.sampled_from([2, 5, 1000]))
def test_placement(sizes, window, most_open):
    packer = Packer(window, most_open)
    pieces = []
    for row, size in enumerate(sizes):
        if rest := size % window:
            counts = {h: int(n) for h, n in enumerate(packer._count) if n}
            assert packer.level(rest) == plain_level(counts, rest, window)
        packer.add(row, np.arange(size))
        assert packer._n_open == sum(map(len, packer._open.values())) <= most_open
        pieces += packer.pieces()
    packer.pour()
    pieces += packer.pieces()
    sequences = check_pieces(pieces, dict(enumerate(sizes)), window)
    assert sum(sum(n for _, n in held) < window for held in sequences.values()) <= window.bit_length()


def test_whole_documents_stay_together_where_they_fit():
    packer = Packer(16)
    for row, size in enumerate([10, 6, 10, 6, 10, 6]):
        packer.add(row, np.arange(size))
    packer.pour()
    assert all(len(ids) in (10, 6) for _, _, ids, _, _ in packer.pieces())


def reassembled(rows):
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    return {k: [i for _, ids in sorted(v) for i in ids] for k, v in found.items()}


def test_operator(spark):
    long = "word salad, " * 40_000
    texts = [*AWKWARD, long]
    rows = [(k, t, f"s{k}", k) for k, t in enumerate(texts)] + [(None, "no id", None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, length long").coalesce(1)
    out = pack_documents(docs, PATH, carry={"sequence_id": "name", "length": "own"}).collect()
    want = dict(enumerate(plain_ids(texts)))
    got = reassembled([r for r in out if r.doc_id is not None])
    assert got == want
    assert all(r.doc_tokens == len(want[r.doc_id]) and r.name == f"s{r.own}" and r.own == r.doc_id and r.length == len(r.ids) // 4 for r in out if r.doc_id is not None)
    assert sum(r.length for r in out if r.doc_id is None) == 2 * len(plain_ids(["no id"])[0])
    assert pack_documents(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        pack_documents(docs, PATH, window=4095)


def test_query_against_plain_tokens(spark):
    out = queries.op11_packing(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: i for r, i in zip(docs, plain_ids([r.text for r in docs]))}
    covered, fill = defaultdict(list), defaultdict(list)
    for r in out:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        covered[r.doc_id].append((r.start, r.length))
        fill[r.sequence_id].append((r.offset, r.length))
    for parts, size in [*((covered[k], len(v)) for k, v in want.items()), *((v, None) for v in fill.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == size if size else at <= 4096 and at & (at - 1) == 0
    assert sorted((tuple(r) for r in queries.op11_packing(spark, SF).collect()), key=repr) == sorted(map(tuple, out), key=repr)
