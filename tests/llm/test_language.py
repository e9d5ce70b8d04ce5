import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm.language import identify_languages, viterbi, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, held_out string, spans int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, None, None, 1, "x", 2) for i, t, l in rows], SCHEMA)


def best_path(score, penalty):
    n, langs = score.shape
    paths = itertools.product(range(langs), repeat=n)
    return max(paths, key=lambda p: (round(sum(score[i, k] for i, k in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:])), 6)))


def value(score, path, penalty):
    return sum(score[i, k] for i, k in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("seed", range(8))
def test_viterbi_against_all_paths(seed):
    rng = np.random.default_rng(seed)
    sizes = [0, 1, 5, 7, 0, 6, 3, 7]
    first = np.concatenate([[0], np.cumsum(sizes)])
    score = -rng.exponential(2.0, (first[-1], 3)).astype(np.float32)
    path = viterbi(score, first, 2.5)
    for a, b in zip(first[:-1], first[1:]):
        if b > a:
            assert value(score[a:b], path[a:b], 2.5) == pytest.approx(value(score[a:b], best_path(score[a:b], 2.5), 2.5), abs=1e-4)


def test_scripts():
    w = words_of(pa.array(["Über Привет Ωμέγα 漢字 12 *** שלום", None or "", "x"]))
    assert w.script.tolist() == [0, 2, 1, 11, -1, -1, 4, 0]
    assert w.letters.tolist() == [4, 6, 5, 2, 0, 0, 4, 1]


EN = "the house that was over there is with the other thing and this is what they have said"
DE = "der hund und die katze sind nicht auf dem dach aber wir haben das schon gesehen heute"
RU = "это очень хороший день и мы пошли гулять по городу вместе с друзьями"


def test_identify(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        lang, words = [("en", EN.split()), ("de", DE.split()), ("ru", RU.split())][i % 3]
        rows.append((i, " ".join(rng.choice(words, 30)), lang))
    mixed = " ".join([EN, EN, DE, DE])
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 -- ***", "en"), (1003, mixed, None), (None, EN, "en"), (5, EN, "en")]
    rows += [(1004, EN + " ", None), (1005, " ".join([EN] * 3000), None), (1006, "漢字 漢字", None)]
    got = {r.doc_id: r for r in identify_languages(docs(spark, rows).repartition(4)).collect()}
    for i in range(300):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].lang_pred == rows[i][2] or i == 5
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert [(s.first, s.lang) for s in got[1003].spans] == [(0, "en"), (2 * len(EN.split()), "de")]
    assert got[None].lang_pred == "en" and not got[None].held_out
    assert got[1005].lang_pred == "en" and got[1005].score == 1.0
    assert got[1006].lang_pred in ("de", "en", "ru")


def test_held_out_accuracy(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify_languages(frame).where("held_out").join(frame.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98


def test_nothing_to_learn_and_empty(spark):
    rows = identify_languages(docs(spark, [(1, "abc", None), (2, None, "en")])).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    assert identify_languages(docs(spark, [])).count() == 0
