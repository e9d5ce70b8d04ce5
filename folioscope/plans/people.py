"""Names of doctors and institutions: telling them apart, joining their spellings, finding them in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.doctors import doctors_in_text  # noqa: F401
from ..functions.text import fold, words
from ..operators.graph import components
from ..operators.rules import looks_like_a_person


def institution_and_doctor(documents: DataFrame) -> DataFrame:
    """A person's name printed where the institution stands moves to the doctor, and
    `institution_was` keeps what was printed; a doctor already there stays."""
    person = F.coalesce(looks_like_a_person(F.col("provider")), F.lit(False))
    return documents.withColumns(
        {
            "institution_was": F.when(person, F.col("provider")),
            "doctor": F.when(person & (F.trim(F.coalesce("doctor", F.lit(""))) == ""), F.col("provider")).otherwise(F.col("doctor")),
            "provider": F.when(~person, F.col("provider")),
        }
    )


def worth_joining(names: DataFrame, name_col: str = "name", suffix_only: bool = False) -> DataFrame:
    """(a, b): names of two words or more that may be one: the same words, or all words of a among
    those of b (institutions), or a the end of b (doctors).

    A pair must share a's rarest word, so names meet by that word alone and common words make no
    pairs.
    """
    n = names.select(F.col(name_col).alias("name")).distinct().withColumn("words", words(fold(F.col("name")))).where(F.size("words") >= 2)
    each = n.select("name", F.explode(F.array_distinct("words")).alias("word"))
    common = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(common, "word").groupBy("name").agg(F.min(F.struct("n", "word"))["word"].alias("word"))
    a = n.join(rarest, "name").select(F.col("name").alias("a"), F.col("words").alias("words_a"), "word")
    b = each.join(n, "name").select(F.col("name").alias("b"), F.col("words").alias("words_b"), "word")
    met = a.join(b, "word").where("a <> b")
    same = F.col("words_a") == F.col("words_b")
    inside = (F.size(F.array_except("words_a", "words_b")) == 0) & (F.size("words_a") < F.size("words_b"))
    tail = (F.size("words_a") < F.size("words_b")) & (F.slice("words_b", -F.least(F.size("words_a"), F.size("words_b")), F.size("words_a")) == F.col("words_a"))
    return met.where(same & (F.col("a") < F.col("b")) | (tail if suffix_only else inside)).select("a", "b")


def families(pairs: DataFrame) -> DataFrame:
    """(name, family): names that pairs connect; a family is called by its shortest name, then by text."""
    label = components(pairs)
    head = label.groupBy("component").agg(F.min_by("node", F.struct(F.length("node"), "node")).alias("family"))
    return label.join(head, "component").select(F.col("node").alias("name"), "family")


def who_stands_in_the_text(found: DataFrame, id_col: str = "document_id") -> DataFrame:
    by = found.withColumn("folded", fold(F.col("name"))).groupBy("folded")
    return by.agg(F.min("name").alias("name"), F.countDistinct(id_col).alias("documents"), F.count(F.lit(1)).alias("times"))


# ------------------------------------------------------------------ facts about the person


def blood_group(text: Column) -> Column:
    """ABO group as one of O, A, B, AB, from letters of either alphabet or Roman numerals."""
    t = F.upper(F.translate(text, "АВОав о", "ABOAB O"))
    number = F.regexp_extract(t, r"(?<![\p{L}\d])(IV|III|II|I)(?![\p{L}\d])", 1)
    letter = F.regexp_extract(t, r"(?<![\p{L}])(AB|A|B|O|0)(?![\p{L}])", 1)
    named = F.when(letter == "0", "O").when(letter != "", letter)
    return F.coalesce(named, F.when(number == "I", "O").when(number == "II", "A").when(number == "III", "B").when(number == "IV", "AB"))


def rhesus(text: Column) -> Column:
    t = F.lower(text)
    minus = t.rlike(r"(?iU)(neg|отриц|негат|αρνητ)|[-−–]\s*\)?$|rh\s*\(?\s*[-−–]")
    plus = t.rlike(r"(?iU)(pos|полож|позит|θετ)|\+")
    return F.when(minus & ~plus, "-").when(plus & ~minus, "+")


def facts(rows: DataFrame, most: int = 8) -> DataFrame:
    """rows(fact, answer, document_id, date) -> (fact, answer, document_id, date, place, answers): the
    newest row of each different answer, newest first, `most` a fact; answers > 1 is a disagreement."""
    from ..operators.compaction import newest_per_key

    newest = newest_per_key(rows.where("answer is not null"), ["fact", "answer"], [F.col("date").desc_nulls_last(), F.col("document_id")])
    counts = newest.groupBy("fact").agg(F.count(F.lit(1)).alias("answers"))
    first = newest_per_key(newest, ["fact"], [F.col("date").desc_nulls_last(), F.col("document_id"), F.col("answer")], most)
    return first.join(counts, "fact")


def roll(rows: DataFrame, text_col: str) -> DataFrame:
    """Printed texts of a list (diagnoses, medicines): how often, when, and the newest document; undated last."""
    newest = F.max_by("document_id", F.struct(F.col("date").isNotNull(), "date", -F.col("document_id")))
    return rows.groupBy(F.col(text_col).alias("text")).agg(
        F.count(F.lit(1)).alias("times"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), newest.alias("newest_document")
    )
