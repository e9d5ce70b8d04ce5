"""Values and documents that look misread beside the others of their test."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import with_groups


def medians(values: DataFrame, keys: list[str], number: str) -> DataFrame:
    """keys, `median` (exact) and `n` of the numbers that are not null.

    Equal numbers are counted first, in the map side; the middle ones are found by running sums of
    the counts, so that no group's numbers are held in memory.
    """
    counts = values.where(F.col(number).isNotNull()).groupBy(*keys, F.col(number).alias("_x")).agg(F.count(F.lit(1)).alias("_k"))
    totals = counts.groupBy(*keys).agg(F.sum("_k").alias("n"))
    upto = F.sum("_k").over(Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    met = with_groups(counts.withColumn("_upto", upto), totals, {k: f"_key_{k}" for k in keys})  # null keys are keys
    holds = lambda place: (F.col("_upto") - F.col("_k") < place) & (place <= F.col("_upto"))
    lower, upper = holds(F.ceil(F.col("n") / 2)), holds(F.floor(F.col("n") / 2) + 1)
    middle = (F.max(F.when(lower, F.col("_x"))) + F.max(F.when(upper, F.col("_x")))) / 2
    return met.where(lower | upper).groupBy(*keys).agg(middle.alias("median"), F.max("n").alias("n"))


def far_from_median(values: DataFrame, keys: list[str], number: str, times: float = 10.0, least: int = 4) -> DataFrame:
    """Rows at least `times` the exact median of their keys, or at most its `times`-th part, where
    the keys have `least` positive numbers."""
    positive = values.where(F.col(number) > 0)
    middle = medians(positive, keys, number).where(F.col("n") >= least).withColumnRenamed("n", "readings")
    met = positive.join(middle, keys)
    return met.where((F.col(number) >= times * F.col("median")) | (F.col(number) * times <= F.col("median")))


def lone_units(values: DataFrame, test: str, unit: str, most: int = 1, others: int = 10) -> DataFrame:
    """(test, unit, n): units of at most `most` values in tests where all other units have `others` or more."""
    habit = values.where(F.col(unit).isNotNull() & (F.trim(unit) != "")).groupBy(test, unit).agg(F.count(F.lit(1)).alias("n"))
    total = habit.groupBy(test).agg(F.sum("n").alias("all"))
    return habit.join(total, test).where((F.col("n") <= most) & (F.col("all") - F.col("n") >= others)).select(test, unit, "n")


def unit_missing(values: DataFrame, test: str, unit: str, least: int = 4) -> DataFrame:
    """Rows without a unit in tests where at least `least` values have one."""
    printed = F.col(unit).isNotNull() & (F.trim(unit) != "")
    have = values.where(printed).groupBy(test).agg(F.count(F.lit(1)).alias("with_unit")).where(F.col("with_unit") >= least)
    return values.where(~printed).join(have, test)


def suspicion(findings: DataFrame, weights: DataFrame, most: int = 3) -> DataFrame:
    """findings(document, rule), weights(rule, weight) -> document, weight: each rule counts `most` times at most."""
    times = findings.groupBy("document", "rule").agg(F.count(F.lit(1)).alias("n"))
    weighed = times.join(F.broadcast(weights), "rule") if weights.count() <= 10_000 else times.join(weights, "rule")
    return weighed.groupBy("document").agg(F.sum(F.col("weight") * F.least("n", F.lit(most))).alias("weight"))


def powers_from_the_rest(ranges: DataFrame, test: str, middle: str, least: int = 5, agree: float = 0.75, powers: float = 1.5) -> DataFrame:
    """Ranges whose middle is `powers` powers of ten from the median of their test's, where the test
    has `least` ranges and at least `agree` of them lie within that distance."""
    logs = ranges.where(F.col(middle) > 0).withColumn("_log", F.log10(middle))
    stat = medians(logs, [test], "_log").withColumnsRenamed({"median": "_median", "n": "_n"}).where(F.col("_n") >= least)
    met = logs.join(stat, test).withColumn("_far", F.abs(F.col("_log") - F.col("_median")) >= powers)
    share = met.groupBy(test).agg(F.avg(F.when(F.col("_far"), 0.0).otherwise(1.0)).alias("_share")).where(F.col("_share") >= agree)
    return met.where("_far").join(share, test).drop("_log", "_median", "_n", "_far", "_share")
