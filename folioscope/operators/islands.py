"""Runs of rows: change-point islands, gaps, bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str], order: list[str], begins: Column, name: str = "island") -> DataFrame:
    """Number runs in each key from 1: a row for which `begins` is true, and the first, begin one.

    `begins` may use before(column).  Give keys that cut the data finely (a file, a user).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    flagged = rows.withColumn("_begins", F.when(first | F.coalesce(begins, F.lit(False)), 1).otherwise(0))
    return flagged.withColumn(name, F.sum("_begins").over(w).cast("long")).drop("_begins")


def before(column: str, keys: list[str], order: list[str]) -> Column:
    """The value in the previous row of the key."""
    return F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))


def last_known_before(column: str, keys: list[str], order: list[str]) -> Column:
    """The last value that is not null in the rows before this one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(column, ignorenulls=True).over(w)


def micros(column: str) -> Column:
    """Microseconds of a timestamp with or without zone, as UTC."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def group_documents(pages: DataFrame) -> DataFrame:
    """Classified pages (file, page, page_role, stated_document, text_page, date_on_page) with `document`.

    A document begins at a file's first page, at a page whose role is `first`, where the stated
    document number changes, and in text files where a page's date differs from the last one known.
    """
    keys, order = ["file"], ["page"]
    known = last_known_before("date_on_page", keys, order)
    moved = F.col("text_page") & F.col("date_on_page").isNotNull() & (F.col("date_on_page") != known)
    stated = ~F.col("stated_document").eqNullSafe(before("stated_document", keys, order))
    return islands(pages, keys, order, (F.col("page_role") == "first") | stated | moved, "document")


def busy_seconds(events: DataFrame, keys: list[str], at: str, tie: str, most: int = 600) -> DataFrame:
    """The sum of gaps of at most `most` seconds between one event and the next."""
    gap = (micros(at) - F.lag(micros(at)).over(Window.partitionBy(*keys).orderBy(at, tie))) / 1e6
    gaps = events.withColumn("_gap", gap)
    counted = F.when((F.col("_gap") > 0) & (F.col("_gap") <= most), F.col("_gap")).otherwise(0.0)
    return gaps.groupBy(*keys).agg(F.sum(counted).alias("busy"), F.count(F.lit(1)).alias("events"))


def sessions(events: DataFrame, keys: list[str], at: str, tie: str, gap: int = 600) -> DataFrame:
    """Sessions of each key: (keys, session, begins, ends, events); a pause longer than `gap` seconds parts them."""
    pause = micros(at) - F.lag(micros(at)).over(Window.partitionBy(*keys).orderBy(at, tie))
    numbered = islands(events.withColumn("_pause", pause), keys, [at, tie], F.col("_pause") > gap * 1_000_000, "session")
    return numbered.groupBy(*keys, "session").agg(
        F.min(at).alias("begins"), F.max(at).alias("ends"), F.count(F.lit(1)).alias("events")
    )


def busiest_window(events: DataFrame, keys: list[str], at: str, minutes: int = 10) -> DataFrame:
    """The most events of a key in any trailing window of so many minutes, both ends counted.

    No task gets a whole key: its events are cut into stretches of the window's length, each event
    goes to its own stretch and as a guest to the next, and stretches are counted apart.
    """
    length = minutes * 60_000_000
    dealt = events.select(*keys, micros(at).alias("_at")).withColumn("_own", F.floor(F.col("_at") / length))
    dealt = dealt.withColumn("_stretch", F.explode(F.array("_own", F.col("_own") + 1)))
    w = Window.partitionBy(*keys, "_stretch").orderBy("_at").rangeBetween(-length, 0)
    counted = dealt.withColumn("_n", F.count(F.lit(1)).over(w)).where("_own = _stretch")
    return counted.groupBy(*keys).agg(F.max("_n").alias("busiest"), F.count(F.lit(1)).alias("events"))


def burst_of_log(log: DataFrame, at: str = "at", minutes: int = 10, unusual: int = 60) -> DataFrame:
    """One row for a whole access log (at, allowed): calls, refusals, busiest window, unusual.

    No task gets the whole log: events are cut into stretches of the window's length, each event
    goes to its own stretch and as a guest to the next, and stretches are counted apart.
    """
    length = minutes * 60_000_000
    calls = log.where("allowed").select(micros(at).alias("_at")).withColumn("_own", F.floor(F.col("_at") / length))
    dealt = calls.withColumn("_stretch", F.explode(F.array("_own", F.col("_own") + 1)))
    w = Window.partitionBy("_stretch").orderBy("_at").rangeBetween(-length, 0)
    counted = dealt.withColumn("_n", F.count(F.lit(1)).over(w)).where("_own = _stretch")
    most = counted.agg(F.coalesce(F.max("_n"), F.lit(0)).cast("long").alias("busiest"))
    repeats = F.coalesce(F.col("repeats"), F.lit(0)) if "repeats" in log.columns else F.lit(0)
    totals = log.agg(
        F.count_if("allowed").alias("calls"),
        F.coalesce(F.sum(F.when(~F.col("allowed"), 1 + repeats)), F.lit(0)).cast("long").alias("refusals"),
    )
    return totals.join(F.broadcast(most)).withColumn("unusual", F.col("busiest") >= unusual)
