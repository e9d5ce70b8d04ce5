"""Queries over one archive.

An Archive holds the tables of one source; there is no query over several, so two sources cannot
meet.  Copies are left out unless asked for.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold

TOOL_LIMIT, PAGE_LIMIT = 200, 5000
PAPERWORK = ("admin", "insurance")


def clamp(limit: int, cap: int = TOOL_LIMIT) -> int:
    return max(1, min(int(limit), cap))


def day(text: str | date | None) -> Column | None:
    """A bound of dates; what is no date is an error and never an empty answer."""
    if text is None:
        return None
    return F.lit(text if isinstance(text, date) else date.fromisoformat(text)).cast("date")


@dataclass
class Filters:
    """Conditions on documents.  None asks for nothing; an empty list of names matches no document."""

    since: str | None = None
    until: str | None = None
    doc_type: str | None = None
    providers: list[str] | None = None
    doctors: list[str] | None = None
    all_copies: bool = False
    paperwork: bool = True
    undated: bool | None = None

    def of(self) -> list[Column]:
        out: list[Column] = []
        if self.since:
            out.append(F.col("date") >= day(self.since))
        if self.until:
            out.append(F.col("date") <= day(self.until))
        if self.doc_type:
            out.append(F.col("doc_type") == self.doc_type)
        else:  # a null type fails NOT IN, as any comparison
            out.append(~F.col("doc_type").isin("blank", *(() if self.paperwork else PAPERWORK)))
        for names, column in ((self.providers, "provider"), (self.doctors, "doctor")):
            if names is not None:
                out.append(F.col(column).isin(*names) if names else F.lit(False))
        if not self.all_copies:
            out.append(F.col("primary_copy"))
        if self.undated is not None:
            out.append(F.col("date").isNull() if self.undated else F.col("date").isNotNull())
        return out


IS_RESULT = "coalesce(value_role, 'result') = 'result'"


def material_key() -> Column:
    """A named material; else whether the source says there is no sample; else unknown."""
    named = F.col("material").isNotNull() & (F.trim("material") != "")
    return F.when(named, F.col("material")).when(F.col("material_source") == "no sample", "not_a_sample").otherwise("unknown")


@dataclass
class Archive:
    """documents(document_id, file_id, date, doc_type, language, provider, doctor, title, primary_copy,
    transcribed, copy_group); observations(observation_id, document_id, page, name, value_numeric,
    unit, material, material_source, flag, value_role, derived, indicator_id); indicators(indicator_id,
    label)."""

    documents: DataFrame
    observations: DataFrame
    indicators: DataFrame

    def found(self, filters: Filters) -> DataFrame:
        out = self.documents
        for condition in filters.of():
            out = out.where(condition)
        return out

    # Documents

    def overview(self) -> DataFrame:
        """One row: documents, transcribed, undated, first and last date of primary copies; all values and files."""
        d = self.documents.agg(
            F.count_if("primary_copy").alias("documents"),
            F.count_if(F.col("primary_copy") & F.col("transcribed")).alias("transcribed"),
            F.count_if(F.col("primary_copy") & F.col("date").isNull()).alias("without_date"),
            F.min(F.when(F.col("primary_copy"), F.col("date"))).alias("first_date"),
            F.max(F.when(F.col("primary_copy"), F.col("date"))).alias("last_date"),
            F.countDistinct("file_id").alias("files"),
            F.countDistinct("copy_group").alias("copy_groups"),
        )
        primary = self.documents.select("document_id", "primary_copy")
        v = self.observations.join(primary, "document_id").agg(
            F.count(F.lit(1)).alias("values_all"), F.count_if("primary_copy").alias("values_primary")
        )
        return d.join(F.broadcast(v))

    def histograms(self) -> DataFrame:
        """(kind, label, documents) for types and languages in one pass over primary copies."""
        rows = self.documents.where("primary_copy").select(
            F.expr("stack(2, 'type', doc_type, 'language', coalesce(language, 'not said')) AS (kind, label)")
        )
        return rows.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("documents"))

    def timeline(self, filters: Filters, limit: int = 50, offset: int = 0) -> DataFrame:
        values = self.observations.groupBy("document_id").agg(F.count(F.lit(1)).alias("value_count"))
        page = self.found(filters).orderBy(F.col("date").desc_nulls_last(), "document_id").offset(max(0, offset)).limit(clamp(limit))
        wide = page.join(values, "document_id", "left").withColumn("value_count", F.coalesce("value_count", F.lit(0)))
        return wide.select("document_id", "date", "doc_type", "provider", "value_count")

    def count_documents(self, filters: Filters) -> DataFrame:
        return self.found(filters).agg(F.count(F.lit(1)).alias("documents"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))

    def years(self, filters: Filters) -> DataFrame:
        dated = self.found(filters).where("date is not null")
        return dated.groupBy(F.year("date").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("documents"))

    def language_counts(self) -> DataFrame:
        return self.documents.groupBy(F.coalesce("language", F.lit("not said")).alias("language")).agg(F.count(F.lit(1)).alias("documents"))

    def lanes(self, filters: Filters) -> DataFrame:
        """(doc_type, year, documents, points of the lane): dated documents by type; a lane's points
        are counted by year, so that no lane is gathered."""
        dated = self.found(filters).where("date is not null")
        by_year = dated.groupBy("doc_type", F.year("date").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("documents"))
        lane = by_year.groupBy("doc_type").agg(F.sum("documents").alias("in_lane"))
        return by_year.join(lane, "doc_type")

    def who_made_them(self) -> DataFrame:
        """(kind, name, documents, first_date, last_date) of institutions and doctors of primary copies."""
        rows = self.documents.where("primary_copy").select(
            "date", F.expr("stack(2, 'institution', provider, 'doctor', doctor) AS (kind, name)")
        )
        named = rows.where("trim(coalesce(name, '')) <> ''")
        return named.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("documents"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))

    def how_many_name_them(self) -> DataFrame:
        said = lambda c: F.count_if(F.col("primary_copy") & (F.trim(F.coalesce(F.col(c), F.lit(""))) != ""))
        return self.documents.agg(said("provider").alias("name_an_institution"), said("doctor").alias("name_a_doctor"))

    # Values

    def joined(self) -> DataFrame:
        heads = self.documents.select("document_id", "file_id", "date", "doc_type", "primary_copy")
        return self.observations.join(heads, "document_id")

    def drawn(self) -> DataFrame:
        """Values that stand against a day: results, not calculated, with a test and a date, primary copies."""
        return self.joined().where("indicator_id is not null and date is not null and primary_copy and not derived").where(IS_RESULT)

    def matching(self, name: str | None = None, indicators: list[str] | None = None, material: str | None = None, derived: bool = True, all_copies: bool = False) -> DataFrame:
        """Values whose folded name has every word of `name`, or that belong to one of the tests: one union."""
        conditions = []
        if name is not None:
            asked = [F.lit(w) for w in name.split()]
            hit = F.lit(True)
            for word in asked:
                hit = hit & F.contains(fold(F.col("name")), fold(word))
            conditions.append(hit)
        if indicators is not None:
            conditions.append(F.col("indicator_id").isin(*indicators) if indicators else F.lit(False))
        out = self.joined()
        if conditions:
            either = conditions[0]
            for c in conditions[1:]:
                either = either | F.coalesce(c, F.lit(False))
            out = out.where(either)
        if material is not None:
            out = out.where(material_key() == material)
        if not derived:
            out = out.where("not derived")
        return out if all_copies else out.where("primary_copy")

    def values(self, limit: int = 50, cap: int = TOOL_LIMIT, **which) -> DataFrame:
        rows = self.matching(**which).orderBy(F.col("date").asc_nulls_last(), "document_id", "observation_id")
        return rows.limit(clamp(limit, cap)).select("observation_id", "document_id", "date", "name", "value_numeric", "unit")

    def value_names(self, contains: str) -> DataFrame:
        named = self.joined().withColumn("folded", fold(F.col("name"))).where(F.contains("folded", fold(F.lit(contains))))
        return named.groupBy("folded", "unit").agg(
            F.count(F.lit(1)).alias("values"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min("name").alias("name")
        )

    def printed_names(self) -> DataFrame:
        named = self.joined().where("primary_copy").withColumn("folded", fold(F.col("name")))
        return named.groupBy("folded").agg(
            F.count(F.lit(1)).alias("values"), F.countDistinct("unit").alias("units"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
            F.concat_ws(",", F.array_sort(F.collect_set("unit"))).alias("unit_list"),
        )

    def indicator_list(self) -> DataFrame:
        """Every test, those without values too: values, dates, number of materials."""
        v = self.joined().where("primary_copy").where(IS_RESULT)
        stat = v.groupBy("indicator_id").agg(
            F.count(F.lit(1)).alias("values"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct(material_key()).alias("materials")
        )
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return self.indicators.join(stat, "indicator_id", "left").select("indicator_id", "label", zero("values"), "first_date", "last_date", zero("materials"))

    def indicator_timeline(self) -> DataFrame:
        """For each test with drawn values: how many, when, materials, and the last value if there is one material."""
        v = self.drawn().withColumn("material_key", material_key())
        last = F.max_by("value_numeric", F.struct("date", "document_id", "observation_id"))
        stat = v.groupBy("indicator_id").agg(
            F.count(F.lit(1)).alias("points"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
            F.countDistinct("material_key").alias("materials"), last.alias("last"),
        )
        return stat.select("indicator_id", "points", "first_date", "last_date", "materials", F.when(F.col("materials") == 1, F.col("last")).alias("last_value"))

    def materials_present(self) -> DataFrame:
        return self.drawn().groupBy(material_key().alias("material")).agg(F.count(F.lit(1)).alias("values"))

    def flagged(self, flag: str | None = None) -> DataFrame:
        """Values with a printed flag, compared without case."""
        rows = self.joined().where("primary_copy and trim(coalesce(flag, '')) <> ''")
        return rows if flag is None else rows.where(fold(F.trim("flag")) == fold(F.lit(flag)))


def verdict(value: Column, low: Column, high: Column) -> Column:
    """Outside the range: true, false, or null where it cannot be told (no value, no range at all)."""
    known = value.isNotNull() & (low.isNotNull() | high.isNotNull())
    return F.when(known, F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False)))


def page_of(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, cap: int = TOOL_LIMIT) -> dict:
    """Rows of a page and how many there are in all: nothing is cut silently."""
    total = rows.count()
    shown = rows.orderBy(*order).offset(max(0, offset)).limit(clamp(limit, cap)).collect()
    after = max(0, offset) + len(shown)
    return {"rows": shown, "returned": len(shown), "offset": offset, "total": total, "next_offset": after if after < total else None}
