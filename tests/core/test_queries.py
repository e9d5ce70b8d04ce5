"""Every registered query of the library against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from folioscope import queries as Q

SF = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(rows):
    def cell(x):
        if isinstance(x, float):
            return None if math.isnan(x) else f"{x:.6g}"
        return None if x is None else str(x)

    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, duck, name):
    out = Q.QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    relation = duck.sql(Q.SQL[name])
    assert sorted(relation.columns) == columns
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: KINDS[k] for c, k in out.dtypes} == kinds
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({Q.SQL[name]})").fetchall()
    assert plain(map(tuple, out.select(*columns).collect())) == plain(want)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1


def test_filters(spark):
    from folioscope.plans.archive import Filters
    from folioscope.plans.bindings import archive

    a = archive(spark, SF)
    assert a.found(Filters(providers=[])).count() == 0 and a.found(Filters(providers=None)).count() > 0
    with pytest.raises(ValueError):
        Filters(since="not a day").of()
    every = a.found(Filters(all_copies=True)).count()
    assert every > a.found(Filters()).count()
    assert a.found(Filters(undated=True)).count() + a.found(Filters(undated=False)).count() == a.found(Filters()).count()


def test_search_in_look_alike_letters(spark):
    from folioscope.plans.search import hits, postings, question_words

    rows = [(1, "Вітамін В12 високий"), (2, "vitamin B12 low"), (3, "nothing here"), (4, None)]
    index = postings(spark.createDataFrame(rows, "id long, text string"), "id", ["text"])
    assert {r.doc for r in hits(index, "b12").collect()} == {1, 2} == {r.doc for r in hits(index, "В12").collect()}
    assert {r.doc for r in hits(index, "vit b12").collect()} == {2}
    assert hits(index, " ?! ").count() == 0 and question_words("") == []
