"""Joins that equality alone does not express: in time, by overlap, of two readings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within_days(left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, days: int) -> DataFrame:
    """Pairs of equal keys whose dates are at most `days` apart; an equi-join on date buckets.

    Buckets are `days` + 1 long, so partners are in the same or a neighbouring bucket: the right
    side goes to three.  A key with very many rows is cut by its buckets.
    """
    width = days + 1
    bucket = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / width)
    a = left.withColumn("_bucket", bucket(left_day))
    b = right.withColumn("_own", bucket(right_day))
    b = b.withColumn("_bucket", F.explode(F.array(*[F.col("_own") + k for k in (-1, 0, 1)]))).drop("_own")
    met = a.join(b, [*keys, "_bucket"]).drop("_bucket")
    return met.where(F.abs(F.datediff(F.col(left_day), F.col(right_day))) <= days)


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], at: str, tie: str, left_id: str) -> DataFrame:
    """For each left row the right row of its key nearest in time, earlier or later; of equally near
    ones the one with the smaller `tie`.  (left_id, tie, gap), gap in microseconds.

    Both sides are merged in order of time, and the last row known before and the first known
    after are taken by window, so a key's rows are never paired with each other.
    """
    from pyspark.sql import Window

    us = F.unix_micros(F.col(at).cast("timestamp"))
    # Of right rows at one instant only the smallest tie can win.
    points = right.groupBy(*keys, us.alias("_at")).agg(F.min(tie).alias("_tie"))
    rows = left.select(*keys, us.alias("_at"), F.col(left_id).alias("_id"), F.lit(None).cast(dict(right.dtypes)[tie]).alias("_tie"))
    both = rows.unionByName(points.select(*keys, "_at", F.lit(None).cast(dict(left.dtypes)[left_id]).alias("_id"), "_tie"))
    known = F.when(F.col("_tie").isNotNull(), F.struct("_at", "_tie"))
    w = Window.partitionBy(*keys).orderBy("_at")
    past = F.last(known, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    later = F.first(known, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    seen = both.withColumn("_past", past).withColumn("_later", later).where("_id is not null")
    choice = lambda p: F.when(p.isNotNull(), F.struct(F.abs(F.col("_at") - p["_at"]).alias("gap"), p["_tie"].alias("tie")))
    best = F.least(choice(F.col("_past")), choice(F.col("_later")))
    return seen.select(F.col("_id").alias(left_id), best["tie"].alias(tie), best["gap"].alias("gap")).where("gap is not null")


def compare_readings(ours: DataFrame, theirs: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Full outer comparison: keys, standing (agreed, only_ours, only_theirs, differs) and, for
    each field, whether it differs (null against null agrees)."""
    a = ours.select(*keys, F.lit(True).alias("_a"), *[F.col(f).alias(f"_a_{f}") for f in fields])
    b = theirs.select(*keys, F.lit(True).alias("_b"), *[F.col(f).alias(f"_b_{f}") for f in fields])
    both = a.join(b, keys, "full_outer")
    differs: list[Column] = [~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")) for f in fields]
    standing = (
        F.when(F.col("_b").isNull(), "only_ours").when(F.col("_a").isNull(), "only_theirs").when(reduce(Column.__or__, differs), "differs").otherwise("agreed")
    )
    met = F.col("_a") & F.col("_b")
    return both.select(*keys, standing.alias("standing"), *[F.coalesce(met & d, F.lit(False)).alias(f"{f}_differs") for f, d in zip(fields, differs)])


def replace_overlapping(kept: DataFrame, new: DataFrame, keys: list[str], pages: str = "pages") -> DataFrame:
    """A rewrite of documents: rows of `kept` that share a page with a new row of the key go, the new come."""
    taken = new.select(*keys, F.explode(pages).alias("_page")).distinct()
    numbered = kept.withColumn("_row", F.monotonically_increasing_id())
    hit = numbered.select(*keys, "_row", F.explode(pages).alias("_page")).join(taken, [*keys, "_page"]).select("_row").distinct()
    return numbered.join(hit, "_row", "left_anti").drop("_row").unionByName(new)
