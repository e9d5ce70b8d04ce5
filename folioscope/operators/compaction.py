"""Append-only logs: the newest line of a key wins, by place in the log and not by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(log: DataFrame, keys: list[str], *place: str) -> DataFrame:
    """The last row of each key.  `place` orders the log totally, e.g. a sequence number.

    As an aggregate, so that each task sends on one row a key: a key with a third of all rows is
    no burden to any task.
    """
    rest = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*place)).alias("_row")
    return log.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*log.columns)


def newest_n(log: DataFrame, keep: int, *place: str) -> DataFrame:
    """Retention: the `keep` newest rows of a whole log (Spark takes the top of each task first)."""
    return log.orderBy(*[F.desc(p) for p in place]).limit(keep)


def newest_per_key(log: DataFrame, keys: list[str], order: list[Column], keep: int = 1) -> DataFrame:
    """The first `keep` rows of each key in the given order (Spark cuts groups before it shuffles)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return log.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")


def not_done(wanted: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Resume: what is wanted and not in the ledger of done keys.  Null keys are never done."""
    return wanted.join(ledger.select(*keys).distinct(), keys, "left_anti")
