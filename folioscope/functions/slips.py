"""One-letter slips of a vocabulary: words with one letter typed in another alphabet, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fold
from .tokens import TWINS


def slips_of(word: Column) -> Column:
    """Every spelling of a word with exactly one letter replaced by one that looks alike in another alphabet.

    A word with fewer than two letters has none.
    """
    alike = F.create_map(*[F.lit(x) for letter, twins in TWINS.items() for x in (letter, twins)])

    def at(k: Column) -> Column:
        twins = F.split(F.coalesce(F.try_element_at(alike, F.substr(word, k, F.lit(1))), F.lit("")), "")
        made = F.transform(F.filter(twins, lambda t: t != ""), lambda t: F.concat(F.substr(word, F.lit(1), k - 1), t, F.substr(word, k + 1)))
        return made

    letters = F.length(F.regexp_replace(word, r"[^\p{L}]", ""))
    every = F.flatten(F.transform(F.sequence(F.lit(1), F.length(word)), at))
    return F.when(letters > 1, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def with_slips(vocabulary: DataFrame, meaning: str, spelling: str) -> DataFrame:
    """(spelling, meaning, slipped): the vocabulary's own spellings, in small letters, and their slips.

    A slip that two meanings claim, as written or folded, is read as neither.  Own spellings stay:
    one that is a slip of another meaning's is a spelling of its own.  Spellings that two meanings
    own are left to names_claimed_twice().  One shuffle by spelling and one by its fold.
    """
    own = vocabulary.select(F.col(meaning).alias("meaning"), F.lower(F.trim(spelling)).alias("spelling")).where("spelling <> '' AND meaning IS NOT NULL").distinct()
    slipped = own.select("meaning", F.explode(slips_of(F.col("spelling"))).alias("spelling"), F.lit(True).alias("slipped"))
    every = own.withColumn("slipped", F.lit(False)).unionByName(slipped)
    by_spelling = every.groupBy("spelling").agg(
        F.min("meaning").alias("meaning"), (F.min("meaning") != F.max("meaning")).alias("torn"), F.bool_and("slipped").alias("slipped"), F.min(F.when(~F.col("slipped"), F.col("meaning"))).alias("owner"),
        F.max("meaning").alias("other"),
    )
    by_fold = by_spelling.groupBy(fold(F.col("spelling")).alias("folded")).agg((F.min("meaning") != F.max("other")).alias("contested"))
    met = by_spelling.withColumn("folded", fold(F.col("spelling"))).join(by_fold, "folded")
    kept = met.where(~F.col("slipped") | ~(F.col("torn") | F.col("contested")))
    return kept.select("spelling", F.when(F.col("slipped"), F.col("meaning")).otherwise(F.col("owner")).alias("meaning"), "slipped")


def read_spellings(rows: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """rows with what their spelling means, null if nothing, by an equi-join on the spelling in small letters."""
    keyed = rows.withColumn("_spelling", F.lower(F.trim(column)))
    return keyed.join(table.withColumnRenamed("spelling", "_spelling"), "_spelling", "left").drop("_spelling")
