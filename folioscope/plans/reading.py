"""What was read of an archive: summaries, what is still to do, dates of documents, reading prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_EXTRACTED = ("admin", "insurance", "id_document", "blank")


def goes_to_extract() -> Column:
    return F.col("error").isNull() & F.col("legible") & ~F.col("doc_type").isin(*NOT_EXTRACTED)


def classification_problems() -> Column:
    """The names of what is doubtful about a classified page."""
    return F.array_compact(
        F.array(
            F.when(F.col("confidence") < 0.8, "low_confidence"), F.when(~F.col("legible"), "not_legible"), F.when(F.col("doc_type") == "other", "type_other")
        )
    )


def classify_summary(pages: DataFrame) -> DataFrame:
    """(kind, label, pages): histograms by route, type, language and confidence in one pass."""
    level = F.when(F.col("confidence") < 0.5, "below 0.5").when(F.col("confidence") < 0.8, "0.5 to 0.8").when(F.col("confidence") < 0.95, "0.8 to 0.95").otherwise("0.95 and above")
    rows = pages.withColumn("_level", level).select(
        F.expr("stack(4, 'route', route, 'type', doc_type, 'language', coalesce(language, 'not said'), 'confidence', _level) AS (kind, label)")
    )
    return rows.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("pages"))


def inventory_summary(files: DataFrame) -> DataFrame:
    return files.groupBy("category").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.coalesce(F.sum("parts"), F.lit(0)).cast("long").alias("parts"), F.count("error").alias("errors"), F.count("skipped").alias("skipped")
    )


def file_reading(pages: DataFrame) -> DataFrame:
    """pages(file, page, lines, unreadable) -> (file, percent): the mean share of lines read, rounded
    down; 100 only if all were."""
    share = F.when(F.col("lines") + F.col("unreadable") > 0, F.col("lines") / (F.col("lines") + F.col("unreadable")))
    mean = pages.groupBy("file").agg(F.avg(share).alias("share"))
    return mean.select("file", F.when(F.col("share") == 1, 100).otherwise(F.least(F.floor(F.col("share") * 100), F.lit(99))).cast("int").alias("percent"))


def coverage(files: DataFrame, pages: DataFrame, documents: DataFrame, classified: DataFrame, extracted: DataFrame) -> DataFrame:
    """(grain, left): files without a page, pages not classified, documents not read."""
    left = lambda a, b, keys, grain: a.join(b.select(*keys).distinct(), keys, "left_anti").agg(F.count(F.lit(1)).alias("left")).select(F.lit(grain).alias("grain"), "left")
    return left(files, pages, ["file"], "files").union(left(pages, classified, ["file", "page"], "pages")).union(left(documents, extracted, ["document_id"], "documents"))


def document_parts(documents: DataFrame, observations: DataFrame, document_id: int, limit: int = 50, offset: int = 0) -> dict[str, DataFrame]:
    """A document's header, a page of its values, and how many there are in all."""
    own = observations.where(F.col("document_id") == document_id)
    return {
        "header": documents.where(F.col("document_id") == document_id),
        "values": own.orderBy("page", "observation_id").offset(max(0, offset)).limit(max(1, limit)),
        "counts": own.agg(F.count(F.lit(1)).alias("values")),
    }


def document_of_finding(findings: DataFrame, documents: DataFrame) -> DataFrame:
    """findings(file, page) met with documents(document_id, file, pages array)."""
    by_page = documents.select("document_id", "file", F.explode("pages").alias("page"))
    return findings.join(by_page, ["file", "page"])


def document_dates(rows: DataFrame, today: Column, apart: int = 60) -> DataFrame:
    """rows(document_id, person, study, report, page_date, second_look: dates; birth_dates array, printed, ambiguous)
    with `date`, `date_source` and `date_flags`.

    A person's word comes first, then the study's date, the report's, the page's, a second look;
    birth dates never count, except what a person says.
    """
    sound = lambda c: F.when(~F.coalesce(F.array_contains("birth_dates", F.col(c)), F.lit(False)), F.col(c))
    order = ["study", "report", "page_date", "second_look"]
    pick = F.coalesce(
        F.when(F.col("person").isNotNull(), F.struct(F.col("person").alias("date"), F.lit("person").alias("source"))),
        *[F.when(sound(c).isNotNull(), F.struct(sound(c).alias("date"), F.lit(c).alias("source"))) for c in order],
    )
    out = rows.withColumn("_pick", pick)
    date, source = F.col("_pick.date"), F.col("_pick.source")
    free = F.coalesce(source, F.lit("")) != "person"
    born = F.lit(False)
    for c in order:
        born = born | F.coalesce(F.array_contains("birth_dates", F.col(c)), F.lit(False))
    flags = F.array_compact(
        F.array(
            F.when(date.isNull() & F.col("printed").isNotNull(), "not_read"),
            F.when(free & F.coalesce("ambiguous", F.lit(False)), "ambiguous"),
            F.when(date > today, "future"),
            F.when(F.year(date) < 1900, "early"),
            F.when(free & (F.abs(F.datediff("study", "report")) > apart), "apart"),
            F.when(free & born, "birth_date"),
            F.when(source == "second_look", "second_look"),
        )
    )
    return out.withColumn("date", date).withColumn("date_source", source).withColumn("date_flags", flags).drop("_pick")


def day_first_evidence(dates: DataFrame) -> DataFrame:
    """dates(document_id, provider, printed) with `day_first`: by the document's own printed dates, else
    by its provider's; null without evidence or where it contradicts itself."""
    a = F.regexp_extract("printed", r"(?<!\d)(\d{1,2})[./-](\d{1,2})[./-]\d{2,4}", 1).try_cast("int")
    b = F.regexp_extract("printed", r"(?<!\d)(\d{1,2})[./-](\d{1,2})[./-]\d{2,4}", 2).try_cast("int")
    told = dates.withColumn("day", (a > 12) & (b <= 12)).withColumn("month", (b > 12) & (a <= 12))
    say = F.when(F.bool_or("day") & ~F.bool_or("month"), True).when(F.bool_or("month") & ~F.bool_or("day"), False)
    own = told.groupBy("document_id", "provider").agg(say.alias("own"))
    theirs = told.groupBy("provider").agg(say.alias("theirs"))
    return own.join(theirs, "provider", "left").select("document_id", F.coalesce("own", "theirs").alias("day_first"))


def date_label(date: Column, precision: Column) -> Column:
    return F.when(precision == "year", F.date_format(date, "yyyy")).when(precision == "month", F.date_format(date, "MM.yyyy")).otherwise(F.date_format(date, "dd.MM.yyyy"))


def reading_prices(runs: DataFrame, least_pages: int = 200) -> DataFrame:
    """runs(text_pages, image_pages, seconds) -> seconds a page of each kind by least squares; null where
    the runs do not tell them apart, a price is not positive, or pages are too few."""
    s = runs.agg(
        *[F.sum(F.col(x) * F.col(y)).cast("double").alias(n) for x, y, n in (("text_pages", "text_pages", "xx"), ("text_pages", "image_pages", "xy"), ("image_pages", "image_pages", "yy"), ("text_pages", "seconds", "xs"), ("image_pages", "seconds", "ys"))],
        F.sum(F.col("text_pages") + F.col("image_pages")).alias("pages"),
    )
    s = s.withColumn("det", F.expr("xx * yy - xy * xy"))
    s = s.withColumn("text", F.expr("(xs * yy - ys * xy) / nullif(det, 0)")).withColumn("image", F.expr("(ys * xx - xs * xy) / nullif(det, 0)"))
    good = (F.abs("det") > 1e-9) & (F.col("text") > 0) & (F.col("image") > 0) & (F.col("pages") >= least_pages)
    return s.select(F.when(good, F.col("text")).alias("text_price"), F.when(good, F.col("image")).alias("image_price"))
