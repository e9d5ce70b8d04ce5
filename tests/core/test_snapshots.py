"""Snapshots compared by digests: what is equal, where a key is placed, and how a place is found."""

from pyspark.sql import functions as F

from folioscope.operators import snapshots

KEYS = ["k", "l"]


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_zeros_of_either_sign_are_alike_and_hide_no_later_difference(spark):
    one = spark.range(400).select((F.col("id") / 4).cast("long").alias("k"), (F.col("id") % 4).alias("l"), F.lit(0.0).alias("x"))
    other = one.withColumn("x", F.when(F.col("k") < 20, F.lit(-0.0)).when((F.col("k") == 90) & (F.col("l") == 2), F.lit(1.0)).otherwise(F.col("x")))
    assert rows(snapshots.first_difference(one, other, KEYS)) == [(90, 2, 1, 1)]
    assert rows(snapshots.first_difference(one, other.where("k < 20").unionByName(one.where("k >= 20")), KEYS)) == []


def test_columns_of_two_types_and_nulls(spark):
    one = spark.createDataFrame([(1, None, 2.5), (None, 1, None), (None, None, 1.0)], "k int, l long, x double")
    wide = one.selectExpr("cast(k as long) k", "cast(l as int) l", "x")
    assert rows(snapshots.first_difference(one, wide, KEYS)) == []
    assert rows(snapshots.first_difference(one, wide.where("k is not null or l is not null"), KEYS)) == [(None, None, 1, 0)]
    assert rows(snapshots.first_difference(one, wide.unionByName(wide.where("k = 1")), KEYS)) == [(1, None, 1, 2)]
    assert rows(snapshots.first_difference(one.where("false"), wide, KEYS)) == [(None, None, 0, 1)]


def test_places_are_those_of_a_scan_of_the_edges(spark):
    many = spark.range(3000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 3).alias("l"))
    for cut in (snapshots.edges(many, KEYS), snapshots.edges(many.where("k < 5"), KEYS), snapshots.edges(many.where("false"), KEYS)):
        edges = [tuple(e) for e in cut.first()["edges"]]
        for k, l, place in rows(snapshots._placed(many, KEYS, cut).select("k", "l", "place")):
            assert place == max(sum(e <= (k, l) for e in edges) - 1, 0)
