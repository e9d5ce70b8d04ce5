"""The vocabulary of tests: one owner a spelling, values joined to it, decisions about groups of names, and
questions answered by printed names first and by everyday words only where those say nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD, fold, fold_text
from ..operators.compaction import latest_by


def refolded(stored: DataFrame) -> DataFrame:
    """stored(indicator_id, label, status, spelling, proposed, edited) with `folded`, by the fold of today.

    Spellings that fold alike are one within an indicator, and one that is approved is not also
    proposed.  Blank spellings go.
    """
    rows = stored.withColumn("folded", F.trim(fold(F.col("spelling")))).where("folded <> ''")
    keys = ["indicator_id", "folded"]
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct("label", "status"), "edited").alias("row"), F.bool_and("proposed").alias("proposed"), F.max("edited").alias("edited")
    ).select(*keys, "row.label", "row.status", "proposed", "edited")


def owners(stored: DataFrame) -> DataFrame:
    """(folded, indicator_id): of each approved spelling the one owner, the indicator that took it last; a
    smaller id first if two did at once."""
    held = refolded(stored).where("status = 'approved' AND NOT proposed")
    order = held.withColumn("_tie", -F.xxhash64("indicator_id")).withColumn("_first", F.struct("edited", "_tie"))
    return latest_by(order.select("folded", "indicator_id", "_first"), ["folded"], "_first").select("folded", "indicator_id")


def names_claimed_twice(stored: DataFrame) -> DataFrame:
    """(folded, claimed_by, owner): spellings that more than one indicator holds, and who has them."""
    held = refolded(stored).where("status = 'approved' AND NOT proposed")
    claims = held.groupBy("folded").agg(F.array_sort(F.collect_set("indicator_id")).alias("claimed_by")).where(F.size("claimed_by") > 1)
    return claims.join(owners(stored).withColumnRenamed("indicator_id", "owner"), "folded")


def values_to_indicators(values: DataFrame, stored: DataFrame, name: str = "name") -> DataFrame:
    """values with indicator_id, null where no approved spelling is theirs.  One equi-join by the folded name."""
    found = owners(stored).withColumnsRenamed({"folded": "_folded", "indicator_id": "_owner"})
    met = values.withColumn("_folded", F.trim(fold(F.col(name)))).join(found, "_folded", "left")
    return met.withColumn("indicator_id", F.col("_owner")).drop("_folded", "_owner")


def group_decisions(proposed: DataFrame, settled: DataFrame, refused: DataFrame) -> DataFrame:
    """What to do with proposed groups of names: (group, verdict, within, left_over).

    All three tables are (group, name).  `refused`: exactly this set was turned down before, known by
    its signature, the sorted folded names.  `settled`: every name is in one settled group,
    `within`.  `open` otherwise, and left_over are the names that no settled group has.  Names are
    few a group; groups may be many.
    """
    folded = lambda t: t.select("group", F.trim(fold(F.col("name"))).alias("name")).where("name <> ''").distinct()
    ours, theirs = folded(proposed), folded(settled)
    signature = F.array_join(F.array_sort(F.collect_set("name")), "\n").alias("signature")
    ours_by, refused_by = ours.groupBy("group").agg(signature, F.count(F.lit(1)).alias("n")), folded(refused).groupBy("group").agg(signature)
    known = refused_by.select("signature").distinct().withColumn("known", F.lit(True))
    met = ours.join(theirs.withColumnRenamed("group", "within"), "name", "left")
    shared = met.where("within is not null").groupBy("group", "within").agg(F.count(F.lit(1)).alias("shared"))
    whole = shared.join(ours_by.select("group", "n"), "group").where("shared = n").groupBy("group").agg(F.min("within").alias("within"))
    left = met.groupBy("group", "name").agg(F.max("within").alias("any")).where("any is null").groupBy("group").agg(F.array_sort(F.collect_list("name")).alias("left_over"))
    out = ours_by.join(known, "signature", "left").join(whole, "group", "left").join(left, "group", "left")
    verdict = F.when(F.col("known"), "refused").when(F.col("within").isNotNull(), "settled").otherwise("open")
    return out.select("group", verdict.alias("verdict"), "within", F.coalesce("left_over", F.array().cast("array<string>")).alias("left_over"))


# Everyday words, and the names that forms print for the same.
EVERYDAY = [
    (["sugar", "blood sugar", "azúcar", "ζάχαρη", "сахар", "цукор", "сахар в крови", "цукор у крові"], ["Glucose", "Glucosa", "Γλυκόζη", "Глюкоза"]),
    (["salt", "sal", "αλάτι", "соль", "сіль"], ["Sodium", "Sodio", "Νάτριο", "Натрий", "Натрій"]),
    (["white blood cells", "white cell count", "glóbulos blancos", "λευκά αιμοσφαίρια", "белые клетки", "білі клітини"], ["Leukocytes", "White cells", "Leucocitos", "Λευκά", "Лейкоциты", "Лейкоцити"]),
    (["red blood cells", "red cell count", "glóbulos rojos", "ερυθρά αιμοσφαίρια", "красные клетки", "червоні клітини"], ["Erythrocytes", "Red cells", "Hematíes", "Ερυθρά", "Эритроциты", "Еритроцити"]),
    (["витамин д", "вітамін д", "вит д", "віт д"], ["Vitamin D", "Vitamina D", "Βιταμίνη D", "Витамин D", "Вітамін D"]),
]


def stands_for(question: str, everyday: list[tuple[list[str], list[str]]] | None = None) -> list[str]:
    """The printed names, folded, of an everyday word; the whole question must be that word."""
    asked = (fold_text(question) or "").strip()
    said = {fold_text(w): names for words, names in (EVERYDAY if everyday is None else everyday) for w in words}
    return list(dict.fromkeys(fold_text(n) or "" for n in said.get(asked, [])))


def _answers(folded: Column, text: str) -> Column:
    """A name that holds the text, or stands alone, as a word of four letters or more, inside it."""
    words = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lit(text), F.lit(WORD), F.lit(0)), " "), F.lit(" "))
    alone = (F.length(folded) >= 4) & F.contains(words, F.concat(F.lit(" "), folded, F.lit(" ")))
    return F.contains(folded, F.lit(text)) | alone


def tests_asked(names: DataFrame, documents: DataFrame, question: str, everyday: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """(kind, answer, said, documents): what a question about tests gets.

    `test`: the indicators of names(indicator_id, name) that hold the question or stand alone in it,
    with `said` empty.  Only if there is none, those of the printed names that an everyday word
    stands for, with `said` that word.  Only if there is none either, `language` rows: how many
    documents(document_id, language) each language has, for nothing found is no evidence of
    absence.  One plan: a one-row count of the former answers guards the latter; the driver asks
    nothing in between.
    """
    asked = (fold_text(question) or "").strip()
    held = names.select("indicator_id", fold(F.col("name")).alias("folded"))
    row = lambda df, said: df.select(F.lit("test").alias("kind"), F.col("indicator_id").cast("string").alias("answer"), F.lit(said).alias("said"), F.lit(None).cast("long").alias("documents")).distinct()
    by_name = row(held.where(_answers(F.col("folded"), asked) if asked else F.lit(False)), "")
    printed = stands_for(question, everyday)
    fits = F.lit(False)
    for name in printed:
        fits = fits | _answers(F.col("folded"), name)
    none_by_name = by_name.agg(F.count(F.lit(1)).alias("_n"))
    by_word = row(held.where(fits), question.strip()).crossJoin(F.broadcast(none_by_name)).where("_n = 0").drop("_n")
    found = by_name.unionByName(by_word)
    counts = documents.groupBy(F.coalesce("language", F.lit("not said")).alias("answer")).agg(F.count(F.lit(1)).alias("documents"))
    none = found.agg(F.count(F.lit(1)).alias("_n"))
    empty = counts.crossJoin(F.broadcast(none)).where("_n = 0").select(F.lit("language").alias("kind"), "answer", F.lit(question.strip()).alias("said"), "documents")
    return found.unionByName(empty)
