"""Views that put several questions to an archive at once, each a table of (part, ...) rows: a page of the
archive reads one plan, not one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.doctors import doctors_in_text
from ..functions.text import fold, fold_text
from . import people
from .archive import Archive, Filters


def _part(name: str, rows: DataFrame, key: str, n: str) -> DataFrame:
    return rows.select(F.lit(name).alias("part"), F.col(key).cast("string").alias("key"), F.col(n).cast("long").alias("n"))


def _stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def timeline_view(archive: Archive, filters: Filters, feed: str = "timeline") -> DataFrame:
    """(part, key, n): years, makers, what the archive holds, and the feed: `timeline` counts and spans what the
    filters find, `lanes` gives each type's documents by year, `tests` each test's values against a day."""
    held = archive.overview()
    whole = held.select(F.expr("stack(4, 'documents', documents, 'transcribed', transcribed, 'without_date', without_date, 'values_all', values_all) AS (key, n)"))
    parts = [_part("years", archive.years(filters), "year", "documents"), _part("overview", whole, "key", "n")]
    makers = archive.who_made_them().withColumn("who", F.concat_ws(": ", "kind", "name"))
    parts.append(_part("makers", makers, "who", "documents"))
    if feed == "lanes":
        lanes = archive.lanes(filters).withColumn("lane", F.concat_ws(" ", F.coalesce("doc_type", F.lit("?")), F.col("year").cast("string")))
        parts.append(_part("lanes", lanes, "lane", "documents"))
    elif feed == "tests":
        parts.append(_part("tests", archive.drawn().groupBy("indicator_id").agg(F.count(F.lit(1)).alias("n")), "indicator_id", "n"))
    else:
        found = archive.count_documents(filters).select(F.concat_ws("..", F.col("first_date").cast("string"), F.col("last_date").cast("string")).alias("span"), "documents")
        parts.append(_part("found", found, "span", "documents"))
    return _stacked(parts)


def indicators_view(groups: DataFrame, printed: DataFrame, find: str | None = None, status: str | None = None, most: int = 120) -> DataFrame:
    """(part, key, status, values, total): groups(label, status, name) that the folded `find` is in, by label or any
    spelling, with how often their spellings are printed; and names that no group holds, most used
    first, `most` of them, with how many there are in all.  printed(name, values)."""
    use = printed.groupBy(F.trim(fold(F.col("name"))).alias("folded")).agg(F.sum("values").alias("values"), F.min("name").alias("name"))
    held = groups.select("label", "status", F.trim(fold(F.col("name"))).alias("folded")).distinct()
    wanted = held if status is None else held.where(F.col("status") == status)
    asked = (fold_text(find) or "").strip() if find else ""
    hit = F.contains(fold(F.col("label")), F.lit(asked)) | F.contains("folded", F.lit(asked)) if asked else F.lit(True)
    by = wanted.join(use.select("folded", "values"), "folded", "left").groupBy("label", "status")
    shown = by.agg(F.coalesce(F.sum("values"), F.lit(0)).alias("values"), F.bool_or(hit).alias("hit")).where("hit")
    free = use.join(held.select("folded").distinct(), "folded", "left_anti")
    total = free.agg(F.count(F.lit(1)).alias("total"))
    first = free.orderBy(F.desc("values"), "name").limit(most).crossJoin(F.broadcast(total))
    none = F.lit(None)
    return shown.select(F.lit("group").alias("part"), F.col("label").alias("key"), "status", "values", none.cast("long").alias("total")).unionByName(
        first.select(F.lit("name").alias("part"), F.col("name").alias("key"), none.cast("string").alias("status"), "values", "total")
    )


def who_view(archive: Archive, decided: DataFrame, pages: DataFrame) -> DataFrame:
    """(part, key, n): who made the documents, families of names offered and not decided yet, groups that wait or
    were refused (decided(name, verdict)), and doctors that the text of pages names, by documents."""
    makers = archive.who_made_them()
    names = makers.where("kind = 'institution'").select("name")
    families = people.families(people.worth_joining(names)).join(decided.select("name").distinct(), "name", "left_anti")
    offered = families.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    verdicts = decided.groupBy("verdict").agg(F.countDistinct("name").alias("n"))
    doctors = people.who_stands_in_the_text(doctors_in_text(pages))
    return _stacked(
        [
            _part("makers", makers.withColumn("who", F.concat_ws(": ", "kind", "name")), "who", "documents"), _part("families", offered, "family", "n"),
            _part("decided", verdicts, "verdict", "n"), _part("doctors", doctors, "name", "documents"),
        ]
    )


def unreadable_parts(parts: DataFrame, documents: DataFrame) -> DataFrame:
    """parts(document_id, page, why) by where a reader opens them: (file_id, first_page, parts), the parts in the
    order of pages.  A document has few."""
    told = parts.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", "why"))).alias("parts"), F.min("page").alias("first_page"))
    return told.join(documents.select("document_id", "file_id"), "document_id").select("file_id", "document_id", "first_page", "parts")


def extract_summary(readings: DataFrame) -> DataFrame:
    """readings(doc_type, date, model) -> (by, key, documents): totals by type, by year and by model, in one pass."""
    year = F.coalesce(F.year("date").cast("string"), F.lit("undated"))
    rows = readings.select(F.explode(F.array(*[F.struct(F.lit(by).alias("by"), F.coalesce(key, F.lit("not said")).alias("key")) for by, key in (("type", F.col("doc_type")), ("year", year), ("model", F.col("model")))])).alias("t"))
    return rows.groupBy("t.by", "t.key").agg(F.count(F.lit(1)).alias("documents"))
