import math

import duckdb
import pytest

from folioscope.llm import queries

SF = "/root/testdata/sf0.001"


def plain(value):
    return round(value, 3) if isinstance(value, float) and not math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_its_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    base = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "embeddings", "conversations"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = base.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = [tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()]
    wanted = [tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in want.fetchall()]
    assert sorted(rows, key=repr) == sorted(wanted, key=repr)
