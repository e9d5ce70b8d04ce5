import pyspark.sql.functions as F
import pytest

from folioscope.plans import work


def test_years():
    assert work.years_named("1992-1994, 2025,1993") == [1992, 1993, 1994, 2025] and work.years_named("") == []
    for bad in ("92", "1995-1992", "1992;1993"):
        with pytest.raises(ValueError):
            work.years_named(bad)


def test_calls(spark):
    rows = [(1, []), (2, [4]), (3, [1, 2, 3]), (4, [1, 2, 3, 4, 5, 6])]
    frame = spark.createDataFrame(rows, "k int, pages array<int>")
    got = {r.k: r.c for r in frame.select("k", work.call_chunks(F.col("pages"), 3).alias("c")).collect()}
    assert got == {1: [], 2: [[4]], 3: [[1, 2, 3]], 4: [[1, 2, 3], [1, 4, 5], [1, 6]]}
    got = {r.k: r.c for r in frame.select("k", work.call_chunks(F.col("pages"), 4, False).alias("c")).collect()}
    assert got == {1: [], 2: [[4]], 3: [[1, 2, 3]], 4: [[1, 2, 3, 4], [5, 6]]}


def test_close_ups(spark):
    documents = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "document_id int, from_images boolean")
    unreadable = spark.createDataFrame([(1,), (1,), (2,), (3,)], "document_id int")
    passes = spark.createDataFrame([(2, "close-up"), (1, "first")], "document_id int, kind string")
    assert [r.document_id for r in work.needs_a_close_up(documents, unreadable, passes).collect()] == [1]


def test_name_order(spark):
    names = spark.createDataFrame([("Ёлка",), ("Жук",), ("éclair",), ("Zoo",), ("Apple",)], "n string")
    assert [r.n for r in work.in_name_order(names, "n").collect()] == ["Apple", "éclair", "Zoo", "Ёлка", "Жук"]


def test_cuts(spark):
    frame = spark.createDataFrame([([500, 10, 150, 220, 400],), ([],)], "p array<int>")
    assert [r[0] for r in frame.select(work.cuts_in(F.col("p"))).collect()] == [[10, 220, 500], []]
