"""Composed views on small tables: nulls, empty tables, ties."""

from folioscope.plans import views


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_vocabulary(spark):
    groups = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "z"), ("c", "w")], "label string, name string")
    printed = spark.createDataFrame([("x", 3), ("y", 2), ("q", 1)], "name string, values long")
    assert rows(views.group_uses(groups, printed)) == [("a", 2, 2, 5), ("b", 1, 0, 0), ("c", 1, 0, 0)]
    assert rows(views.names_without_group(groups, printed)) == [("q", 1)]
    none = printed.where("false")
    assert rows(views.group_uses(groups, none)) == [("a", 2, 0, 0), ("b", 1, 0, 0), ("c", 1, 0, 0)]
    assert rows(views.groups_to_reread(groups, views.digests(groups))) == []
    assert rows(views.groups_to_reread(groups, views.digests(groups.where("name <> 'x'")))) == [("a", 2)]
    sources = spark.createDataFrame([(1, "x"), (2, "y"), (1, "z"), (1, "z")], "source long, name string")
    assert rows(views.carried_joins(groups, sources)) == [("a", "proposed", 2), ("b", "settled", 1), ("c", "left", 0)]


def test_sample_of_strata(spark):
    docs = spark.range(100).selectExpr("id", "CASE WHEN id % 10 = 0 THEN NULL ELSE id % 2 END AS kind")
    first = rows(views.sample_of_strata(docs, ["kind"], "id", 4))
    assert first == rows(views.sample_of_strata(docs.repartition(7), ["kind"], "id", 4)) and len(first) == 12
    assert views.sample_of_strata(docs.where("false"), ["kind"], "id", 4).count() == 0


def test_left_to_send(spark):
    pages = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "document_id long, page int")
    assert rows(views.left_to_send(pages, pages.where("page = 1"), pages.where("document_id = 2"))) == [(1, 1), (1, 2)]
    assert rows(views.percent_done(pages, pages.where("page = 1"), ["document_id", "page"], "document_id")) == [(1, 2, 1, 50), (2, 1, 1, 100)]
    assert views.left_to_send(pages, pages, pages).count() == 0


def test_access_counts(spark):
    log = spark.createDataFrame([("a", "t", None), ("a", "t", 4), (None, "t", 0)], "door string, tool string, repeats long")
    assert rows(views.access_counts(log)) == [("a", "t", 2, 6), (None, "t", 1, 1)]
