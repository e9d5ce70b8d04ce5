"""What is done and what is left to do: due documents, second looks, copies, findings in their order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold


def due_documents(pages: DataFrame, classified: DataFrame, documents: DataFrame) -> DataFrame:
    """documents of files of which every page is classified, with `tabular`, their pages with tables, sorted.

    pages(file_id, page, tabular), classified(file_id, page), documents(document_id, file_id, first, last).
    """
    done = classified.select("file_id", "page", F.lit(1).alias("_done")).distinct()
    counts = pages.join(done, ["file_id", "page"], "left").groupBy("file_id").agg(F.count(F.lit(1)).alias("pages"), F.count("_done").alias("done"))
    ready = documents.join(counts.where("pages = done").select("file_id"), "file_id")
    tables = pages.where("tabular").select("file_id", "page")
    met = ready.join(tables, "file_id", "left").where("page is null or page between first and last")
    listed = met.groupBy("document_id").agg(F.array_sort(F.collect_set("page")).alias("tabular"))
    return ready.join(listed, "document_id", "left").withColumn("tabular", F.coalesce("tabular", F.array().cast("array<int>")))


def needs_a_close_up(documents: DataFrame, unreadable: DataFrame, passes: DataFrame) -> DataFrame:
    """Documents read from images that have unreadable parts, and that no close-up pass has seen."""
    return documents.where("from_images").join(unreadable.select("document_id").distinct(), "document_id", "left_semi").join(
        passes.where("kind = 'close-up'").select("document_id"), "document_id", "left_anti"
    )


def years_named(text: str) -> list[int]:
    """"1992-2003,2025" -> the years, sorted; anything else is an error."""
    years: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"(\d{4})(?:\s*-\s*(\d{4}))?", part)
        if not m or int(m[2] or m[1]) < int(m[1]):
            raise ValueError(f"no year and no span of years: {part}")
        years.update(range(int(m[1]), int(m[2] or m[1]) + 1))
    return sorted(years)


def of_years(rows: DataFrame, year: str, text: str) -> DataFrame:
    """Rows whose year is among those named; all if none is."""
    named = years_named(text)
    return rows.where(F.col(year).isin(named)) if named else rows


def call_chunks(pages: Column, most: int, repeat_first: bool = True) -> Column:
    """A document's pages in calls of at most `most`: later calls begin with the first page again."""
    step = most - 1 if repeat_first and most > 1 else most
    rest = F.when(F.size(pages) > 1, F.slice(pages, 2, F.greatest(F.size(pages) - 1, F.lit(1)))).otherwise(F.slice(pages, 1, 0)) if repeat_first and most > 1 else pages
    starts = F.when(F.size(rest) > 0, F.sequence(F.lit(1), F.size(rest), F.lit(step))).otherwise(F.array().cast("array<int>"))
    calls = F.transform(starts, lambda s: F.slice(rest, s, step))
    if not (repeat_first and most > 1):
        return calls
    first = F.slice(pages, 1, 1)
    return F.when(F.size(pages) == 1, F.array(first)).otherwise(F.transform(calls, lambda c: F.concat(first, c)))


def cuts_in(places: Column, least: int = 200) -> Column:
    """Sorted places of cuts, each at least `least` characters behind the one before it that stays."""
    empty = F.array().cast("array<int>")
    keep = lambda kept, p: F.when((F.size(kept) == 0) | (p - F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(0)) >= least), F.array_append(kept, p)).otherwise(kept)
    return F.aggregate(F.array_sort(F.array_distinct(places)), empty, keep)


def hours_for(pages: DataFrame, prices: DataFrame) -> DataFrame:
    """(route, pages, hours): pages(route) at prices(route, seconds) a page; a route without a price has no hours."""
    counts = pages.groupBy("route").agg(F.count(F.lit(1)).alias("pages"))
    return counts.join(F.broadcast(prices.groupBy("route").agg(F.max("seconds").alias("seconds"))), "route", "left").select(
        "route", "pages", (F.col("pages") * F.col("seconds") / 3600.0).alias("hours")
    )


def earlier_readings(readings: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Readings that a later one of their keys displaced, newest first by `place`."""
    newest = readings.groupBy(*keys).agg(F.max(at).alias("_newest"))
    return readings.join(newest, keys).where(F.col(at) < F.col("_newest")).drop("_newest").orderBy(*keys, F.desc(at))


def copy_group_members(documents: DataFrame) -> DataFrame:
    """(copy_group, chosen, date, members): documents of each copy group in order of id, the primary one,
    and the first date that any of them has."""
    held = documents.where("copy_group is not null").groupBy("copy_group")
    return held.agg(
        F.min(F.when(F.col("primary_copy"), F.col("document_id"))).alias("chosen"),
        F.min_by("date", F.when(F.col("date").isNotNull(), F.col("document_id"))).alias("date"),
        F.array_sort(F.collect_list("document_id")).alias("members"),
    )


def review_rows(findings: DataFrame, order: list[str], documents: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings in the rules' order, unknown rules last and by name; in a rule newest documents first, undated
    last.  (place, rule, document_id, date, verdict): the last verdict of a finding, if there is one."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("rule"))
    last = verdicts.groupBy("rule", "document_id").agg(F.max_by("verdict", "seq").alias("verdict"))
    rows = findings.select("rule", "document_id").distinct().join(documents.select("document_id", "date"), "document_id", "left").join(last, ["rule", "document_id"], "left")
    rows = rows.withColumn("place", F.when(place > 0, place).otherwise(F.lit(len(order) + 1)))
    return rows.select("place", "rule", "document_id", "date", "verdict").orderBy("place", "rule", F.col("date").desc_nulls_last(), "document_id")


def in_name_order(rows: DataFrame, name: str, *before: Column) -> DataFrame:
    """Rows in the order of a list: by `before`, then by the folded name, then by the name as it is."""
    return rows.orderBy(*before, fold(F.col(name)), F.col(name))


def stale(built: DataFrame, inputs: DataFrame) -> DataFrame:
    """(source, built, newest, stale): whether an input of a source is newer than its index, or there is none;
    built(source, at), inputs(source, at)."""
    newest = inputs.groupBy("source").agg(F.max("at").alias("newest"))
    index = built.groupBy("source").agg(F.max("at").alias("built"))
    return newest.join(index, "source", "left").withColumn("stale", F.coalesce(F.col("newest") > F.col("built"), F.lit(True)))
