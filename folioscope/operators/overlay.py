"""Human edits laid over what was read: the newest edit of a line wins; an empty one retracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .compaction import latest_by


def overlay(rows: DataFrame, edits: DataFrame, keys: list[str], column: str, place: str = "seq") -> DataFrame:
    """rows with `column` replaced where an edit of the key stands, and `corrected`.

    edits(keys, place, value, removed): of a key's edits the last counts.  An edit without a value
    takes back earlier ones; one that says removed drops the row.
    """
    last = latest_by(edits, keys, place).select(*keys, F.col("value").alias("_value"), F.col("removed").alias("_removed"))
    joined = rows.join(last, keys, "left").where(~F.coalesce("_removed", F.lit(False)))
    kept = joined.withColumn("corrected", F.col("_value").isNotNull()).withColumn(column, F.coalesce("_value", column))
    return kept.drop("_value", "_removed")


def overlay_by_line(lines: DataFrame, edits: DataFrame, column: str = "value") -> DataFrame:
    """lines(document, key, short_key, ...): edits name a line by its key or, if old, its short key.

    A short key counts only where one line of the document has it; a full key goes before it.
    """
    last = latest_by(edits, ["document", "edit_key"], "seq").select("document", "edit_key", "value", "seq")
    full = last.select("document", F.col("edit_key").alias("key"), F.col("value").alias("_full"))
    one = lines.groupBy("document", "short_key").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    short = last.select("document", F.col("edit_key").alias("short_key"), F.col("value").alias("_short")).join(one, ["document", "short_key"])
    joined = lines.join(full, ["document", "key"], "left").join(short, ["document", "short_key"], "left")
    new = F.coalesce("_full", "_short")
    return joined.withColumn("corrected", new.isNotNull()).withColumn(column, F.coalesce(new, column)).drop("_full", "_short")


def unmatched(edits: DataFrame, rows: DataFrame, keys: list[str], place: str = "seq") -> DataFrame:
    """The standing edits whose line is not there any more."""
    return latest_by(edits, keys, place).join(rows.select(*keys).distinct(), keys, "left_anti")
