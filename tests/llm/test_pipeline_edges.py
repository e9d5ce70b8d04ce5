"""Each stage on rows of every awkward kind, and on none."""

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside, and others that they return.
CLASHES = "id long, tie int, key string, hash string, none string, row long, size int, source_size int, pieces int, words int, copy int, shard int, slot int, matches int, spans int, lang_pred string, _known int, _0 int, c0 int, same int, sig int, label int"
EN = "the children often eat a red apple in their garden with some friends to play together and then they go home"
DE = "die kinder essen oft einen roten apfel in ihrem garten mit freunden und spielen dann zusammen bis sie nach hause gehen"
LONG = " ".join(f"{EN} {k}" for k in range(12_000))


def rows():
    plain = [(k, f"{EN if k % 2 else DE} {k} " + " ".join(f"word{k}x{i}" for i in range(20)), "en" if k % 2 else "de", f"s{k % 3}", 1) for k in range(60)]
    odd = [(100, None, "en", "s0", None), (101, "", "de", None, 0), (102, " \n", None, "s1", 2), (None, None, None, None, None)]
    odd += [(None, EN + " of a row without an id", None, None, None), (103, LONG, "en", "s2", 5), (104, LONG + " end", None, "s2", 5)]
    return plain + odd + [plain[5], plain[5], (5, EN + " another text of the same id", "en", "s1", 9)]


def frame(spark, these):
    clash = [None if k % 3 == 0 else ("x" if kind == "string" else k) for k, kind in enumerate(c.split()[1] for c in CLASHES.split(", "))]
    return spark.createDataFrame([(*r, *clash) for r in these], f"{COLUMNS}, {CLASHES}").repartition(3), tuple(clash)


def kept(spark, stage, these):
    docs, clash = frame(spark, these)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, SF)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert all(r[5:] == clash for r in got)
    return sorted((r[0] if r[0] is not None else -1, r[1] or "", r[3] or "", r[4] or 0) for r in got)


def told(these):
    return sorted((r[0] if r[0] is not None else -1, r[1] or "", r[3] or "", r[4] or 0) for r in these)


def test_language_id(spark):
    assert kept(spark, "language_id", rows()) == told(r for r in rows() if r[1] and r[1].strip())


def test_near_dedup(spark):
    got = kept(spark, "simhash_near_dedup", rows())
    gone = {(101, ""), (102, " \n"), (104, LONG + " end"), (-1, "")}  # copies of 100 and 103
    want = {(r[0], r[1]) for r in told(rows())} - gone
    assert {(r[0], r[1]) for r in got} == want and len(got) == len(want)


def test_decontamination(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if len(r.text.split()) > 10)
    bad = [(200, f"{EN} {item} {DE}", "en", "s0", 1), (None, item, None, None, None), (201, LONG + " " + item, "en", "s0", 1)]
    assert kept(spark, "benchmark_decontamination", rows() + bad) == told(rows())


def test_mix_sources(spark):
    these = rows()
    got = kept(spark, "mix_sources", these)
    ids = {r[0] for r in got}
    assert not ids & {100, 101, 102} and all(r[1] and r[3] == len(r[1]) for r in got)
    total = sum(len((r[1] or "").split()) for r in these)
    assert abs(sum(len(r[1].split()) for r in got) - total) < 0.05 * total
    words = {}
    for r in these:
        words.setdefault(-1 if r[0] is None else r[0], set()).update((r[1] or "").split())
    assert all(set(r[1].split()) <= words[r[0]] for r in got)


def test_sharding(spark):
    docs, _ = frame(spark, rows())
    got = corpus_pipeline.sharding(spark, docs, SF).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == sorted(r[0] for r in told(rows()))
    assert len({(r.shard, r.slot) for r in got}) == len(got)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_no_rows(spark, name):
    docs, _ = frame(spark, rows())
    out = dict(corpus_pipeline.STAGES)[name](spark, docs.where("false"), SF)
    assert out.count() == 0 and (name == "sharding" or out.columns == docs.columns)
