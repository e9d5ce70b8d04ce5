"""The store: versions, readers during a rewrite, writers that die or race."""

import json

import pytest

from folioscope.sources import store as S
from folioscope.sources.store import LostRaceError, OtherFormatError, Store, StoreError


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, at long, x string")


def rows_of(df):
    return sorted((r.k or "", r.at, r.x) for r in df.collect())


def test_versions_and_compaction(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ["k"], "at", outgrown=0.5)
    assert store.read() is None and store.versions() == []
    assert store.commit(frame(spark, [(k, 1, "one") for k in "abcdef"] + [("a", 0, "older"), (None, 1, "null")])) == 1
    first = store.manifest()
    assert first["base"] and not first["deltas"]  # everything outgrows nothing
    store.commit(frame(spark, [("a", 2, "two"), ("g", 1, "new"), (None, 2, "null two")]))
    second = store.manifest()
    assert second["base"] == first["base"] and len(second["deltas"]) == 1  # a delta, the base untouched
    want = sorted([("a", 2, "two"), ("g", 1, "new"), ("", 2, "null two"), *((k, 1, "one") for k in "bcdef")])
    assert rows_of(store.read()) == want and rows_of(store.read(1))[1] == ("a", 1, "one")
    store.commit(frame(spark, [("b", 0, "late and older")]))
    assert rows_of(store.read()) == want
    reader = store.read()  # holds its generations, whatever is written meanwhile
    store.commit(frame(spark, [(k, 9, "nine") for k in "abcdefg"]))
    assert not store.manifest()["deltas"] and {r[2] for r in rows_of(store.read())} == {"nine", "null two"}
    assert rows_of(reader) == want
    gone = store.vacuum()
    assert gone == [] or all(g not in (store.manifest()["base"],) for g in gone)
    assert store.versions() == [3, 4] and rows_of(reader) == want


def test_a_batch_that_comes_again_counts_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ["k"], "at")
    store.commit(frame(spark, [("a", 1, "x")]), epoch=0)
    assert store.commit(frame(spark, [("a", 5, "again")]), epoch=0) == 1 and rows_of(store.read()) == [("a", 1, "x")]


def test_a_writer_killed_between_the_two_steps(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), ["k"], "at")
    store.commit(frame(spark, [("a", 1, "x")]))

    def dies(self, held, version):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(S.Store, "_publish", dies)
        with pytest.raises(KeyboardInterrupt):
            store.commit(frame(spark, [("a", 2, "lost")]))
    other = Store(spark, str(tmp_path / "s"), ["k"], "at")
    assert rows_of(other.read()) == [("a", 1, "x")]
    other.commit(frame(spark, [("a", 3, "y")]))
    assert rows_of(other.read()) == [("a", 3, "y")]
    assert other.vacuum()  # what nothing names
    assert rows_of(other.read()) == [("a", 3, "y")]


def test_of_two_writers_one_loses(spark, tmp_path):
    one, two = (Store(spark, str(tmp_path / "s"), ["k"], "at") for _ in range(2))
    one.commit(frame(spark, [("a", 1, "x")]))
    with pytest.raises(LostRaceError):
        two._publish({"format": 1}, 1)
    assert rows_of(two.read()) == [("a", 1, "x")]


def test_other_formats_and_keys_are_errors(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ["k"], "at")
    store.commit(frame(spark, [("a", 1, "x")]))
    with pytest.raises(StoreError):
        Store(spark, str(tmp_path / "s"), ["x"], "at").read()
    store._publish(json.loads(json.dumps({"format": 99})), 2)
    with pytest.raises(OtherFormatError):
        store.read()
