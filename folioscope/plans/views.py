"""Views composed of the archive's tables: histories, samples, vocabulary at work, what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.compaction import newest_per_key
from .archive import IS_RESULT, Archive

def value_history(archive: Archive, name: str, indicators: list[str]) -> DataFrame:
    """Values whose name has every word, and all values of the tests, each once: of values that say the
    same on one page, the first stays."""
    found = archive.matching(name=name, indicators=indicators)
    same = ["document_id", "page", "name", "value_numeric"]
    return found.groupBy(*same).agg(F.min("observation_id").alias("observation_id"), F.min("date").alias("date"))


def unit_habits(archive: Archive) -> DataFrame:
    """(indicator_id, unit, values): how often a test's results are printed in each unit; null is no unit."""
    return archive.joined().where("primary_copy").where(IS_RESULT).groupBy("indicator_id", "unit").agg(F.count(F.lit(1)).alias("values"))


def sample_of_strata(rows: DataFrame, strata: list[str], id_col: str, keep: int) -> DataFrame:
    """`keep` rows of each stratum, the same ones for the same rows: those whose id has the least digest.

    Each task drops what is beyond `keep` before the shuffle, so a large stratum meets in no task.
    """
    return newest_per_key(rows, strata, [F.md5(F.col(id_col).cast("string")), F.col(id_col)], keep)


def source_documents(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """(year, documents, percent, findings): documents by year, how many of them were read, in whole
    percent rounded down, and what the rules found in them.  Undated documents have a null year."""
    each = findings.groupBy("document_id").agg(F.count(F.lit(1)).alias("found"))
    by = documents.join(each, "document_id", "left").groupBy(F.year("date").cast("long").alias("year"))
    counts = by.agg(F.count(F.lit(1)).alias("documents"), F.count_if("transcribed").alias("read"), F.coalesce(F.sum("found"), F.lit(0)).alias("findings"))
    return counts.select("year", "documents", F.floor(F.col("read") * 100 / F.col("documents")).cast("int").alias("percent"), "findings")


def access_counts(log: DataFrame) -> DataFrame:
    """log(door, tool, repeats) -> (door, tool, lines, calls): a line stands for itself and its repeats."""
    return log.groupBy("door", "tool").agg(F.count(F.lit(1)).alias("lines"), F.sum(1 + F.coalesce("repeats", F.lit(0))).alias("calls"))


# ------------------------------------------------------------------ vocabulary


def group_uses(groups: DataFrame, printed: DataFrame) -> DataFrame:
    """groups(label, name) and printed(name, values) -> (label, names, used, values): how many spellings
    a group has, how many of them are printed, and how often in all."""
    met = groups.distinct().join(printed, "name", "left").groupBy("label")
    return met.agg(F.count(F.lit(1)).alias("names"), F.count("values").alias("used"), F.coalesce(F.sum("values"), F.lit(0)).alias("values"))


def names_without_group(groups: DataFrame, printed: DataFrame) -> DataFrame:
    return printed.join(groups.select("name").distinct(), "name", "left_anti")


def _digest() -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_set("name")), "\n"), 256)


def digests(groups: DataFrame) -> DataFrame:
    """(label, names, digest) of groups(label, name); a group is what a person joined, and small."""
    return groups.groupBy("label").agg(F.countDistinct("name").alias("names"), _digest().alias("digest"))


def groups_to_reread(groups: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(label, names): groups of two spellings or more whose names are not those of the last verdict.

    verdicts(label, digest) has one row a label.
    """
    now = digests(groups).where("names > 1")
    return now.join(verdicts.select("label", "digest"), ["label", "digest"], "left_anti").select("label", "names")


def carried_joins(groups: DataFrame, printed: DataFrame) -> DataFrame:
    """groups(label, name) and printed(source, name) -> (label, fate, sources): a group whose names one
    source alone prints is settled there, one of several sources is proposed in each, and one that
    nobody prints is left."""
    where = groups.distinct().join(printed.select("source", "name").distinct(), "name", "left")
    by = where.groupBy("label").agg(F.countDistinct("source").alias("sources"))
    fate = F.when(F.col("sources") == 0, "left").when(F.col("sources") == 1, "settled").otherwise("proposed")
    return by.select("label", fate.alias("fate"), "sources")


# ------------------------------------------------------------------ what a run has still to do


def left_to_send(pages: DataFrame, classified: DataFrame, read: DataFrame) -> DataFrame:
    """pages(document_id, page) that are not classified, and all pages of documents not read, each once."""
    new = pages.join(classified.select("document_id", "page"), ["document_id", "page"], "left_anti")
    unread = pages.join(read.select("document_id").distinct(), "document_id", "left_anti")
    return new.unionByName(unread).select("document_id", "page").distinct()


def percent_done(wanted: DataFrame, done: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(by, wanted, done, percent): rows of `wanted` that are among `done`, in whole percent rounded down."""
    had = done.select(*keys).distinct().withColumn("_had", F.lit(True))
    counts = wanted.join(had, keys, "left").groupBy(by).agg(F.count(F.lit(1)).alias("wanted"), F.count("_had").alias("done"))
    return counts.withColumn("percent", F.floor(F.col("done") * 100 / F.col("wanted")).cast("int"))
