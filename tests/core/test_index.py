"""The kept index: postings of rows by themselves, lengths counted in texts, one shuffle."""

from folioscope.plans.search import hits, keep_index, kept_hits, lengths_of, postings, row_postings


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_row_postings_are_postings_without_a_shuffle(spark, tmp_path):
    texts = [(1, "b a b C b"), (2, ""), (3, None), (4, " ?! "), (5, "x"), (6, "Thát that heon heon, that")]
    docs = spark.createDataFrame(texts, "id long, text string")
    own = row_postings(docs, "id", ["text"])
    assert rows(own) == rows(postings(docs, "id", ["text"])) and own.dtypes == postings(docs, "id", ["text"]).dtypes
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    assert rows(lengths_of(docs, "id", ["text"])) == [(1, 5), (5, 1), (6, 5)]


def test_an_index_of_rows_sums_documents_of_several_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "heon a"), (1, "heon heon b"), (2, "heon"), (3, "other words")], "id long, text string")
    keep_index(row_postings(docs, "id", ["text"]), str(tmp_path), lengths_of(docs, "id", ["text"]))
    assert rows(kept_hits(spark, str(tmp_path), "heon")) == rows(hits(postings(docs, "id", ["text"]), "heon"))
    assert spark.read.parquet(f"{tmp_path}/postings").where("doc = 1 and token = 'heon'").select("tf").collect()[0].tf == 3
    assert rows(spark.read.parquet(f"{tmp_path}/lengths")) == [(1, 5), (2, 1), (3, 2)]
