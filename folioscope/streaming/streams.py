"""Structured Streaming forms.  Each takes a streaming DataFrame; the batch form gives the same for closed groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Store


def event_time(stream: DataFrame, at: str, late: str = "1 hour") -> DataFrame:
    """Event time with zone, as watermarks want it, and how late a row may come."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def tumbling(stream: DataFrame, at: str, length: str, by: str, value: str, late: str = "1 hour") -> DataFrame:
    out = event_time(stream, at, late).groupBy(F.window(at, length), by).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("begins"), F.col("window.end").alias("ends"), by, "events", "total")


def sliding(stream: DataFrame, at: str, length: str, step: str, by: str, late: str = "1 hour") -> DataFrame:
    """Hopping windows: of the trailing window of a burst the streaming approximation."""
    out = event_time(stream, at, late).groupBy(F.window(at, length, step), by).agg(F.count(F.lit(1)).alias("events"))
    return out.select(F.col("window.start").alias("begins"), by, "events")


def sessions(stream: DataFrame, at: str, gap: str, by: str, late: str = "1 hour") -> DataFrame:
    out = event_time(stream, at, late).groupBy(F.session_window(at, gap), by).agg(F.count(F.lit(1)).alias("events"))
    return out.select(F.col("session_window.start").alias("begins"), F.col("session_window.end").alias("ends"), by, "events")


def first_of_key(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Each key once: what a ledger of done keys lets through."""
    return event_time(stream, at, late).dropDuplicatesWithinWatermark(keys)


def keep_latest(spark: SparkSession, path: str, keys: list[str], *place: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the newest row of each key in a Store: a batch writes its own rows, not
    the state, and counts once though it may run again."""
    return Store(spark, path, keys, *place).sink()
