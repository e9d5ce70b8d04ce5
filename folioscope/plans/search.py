"""Full-text search: an inverted index and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import also_written_as, fold, fold_text, snippet, words

K1, B = 1.2, 0.75


def postings(rows: DataFrame, id_col: str, text_cols: list[str], fold_with=fold) -> DataFrame:
    """(doc, token, tf): how often each folded word occurs in a row's texts.  The index to keep."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text_cols])
    tokens = rows.select(F.col(id_col).alias("doc"), F.explode(words(fold_with(text))).alias("token"))
    return tokens.groupBy("doc", "token").agg(F.count(F.lit(1)).alias("tf"))


def row_postings(rows: DataFrame, id_col: str, text_cols: list[str], fold_with=fold) -> DataFrame:
    """postings() of each row by itself, without a shuffle: the words of a row are sorted and their runs measured.
    A document of several rows has a token as often as rows of it have."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text_cols])
    held = rows.select(F.col(id_col).alias("doc"), F.sort_array(words(fold_with(text))).alias("w")).withColumn("n", F.size("w"))
    first = lambda k: (k == 0) | (F.get("w", k) != F.get("w", k - 1))
    runs = held.withColumn("runs", F.when(F.col("n") > 0, F.filter(F.sequence(F.lit(0), F.col("n") - 1), first)))
    run = lambda at, k: F.struct(F.get("w", at).alias("token"), (F.coalesce(F.get("runs", k + 1), F.col("n")) - at).cast("long").alias("tf"))
    return runs.select("doc", F.inline(F.transform("runs", run)))


def lengths_of(rows: DataFrame, id_col: str, text_cols: list[str], fold_with=fold) -> DataFrame:
    """(doc, len): how many words a document has, if any, counted in its texts and not in postings."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text_cols])
    counted = rows.select(F.col(id_col).alias("doc"), F.size(words(fold_with(text))).alias("n"))
    return counted.groupBy("doc").agg(F.sum("n").alias("len")).where("len > 0")


def question_words(question: str) -> list[list[str]]:
    """The words of a question, each with its spellings in look-alike letters.  Every word must be
    found; a word is a prefix."""
    folded = "".join(c if c.isalnum() else " " for c in fold_text(question) or "")
    return [[fold_text(x) for x in also_written_as(w)] for w in folded.split()]


def _matches(token: Column, spellings: list[str]) -> Column:
    hit = F.startswith(token, F.lit(spellings[0]))
    for s in spellings[1:]:
        hit = hit | F.startswith(token, F.lit(s))
    return hit


def hits(index: DataFrame, question: str, lengths: DataFrame | None = None) -> DataFrame:
    """(doc, score): documents with every word; the smaller the score the better.

    BM25 of each spelling as a phrase of its own, as full-text tables of a common embedded database
    compute it: idf = ln((N - n + 0.5) / (n + 0.5)), a millionth at least.  lengths(doc, len) says how
    many words documents have, if the index is not the whole of them.
    """
    asked = question_words(question)
    if not asked:
        return index.select("doc", F.lit(0.0).alias("score")).limit(0)
    phrases = [(k, s) for k, spellings in enumerate(asked) for s in spellings]
    wanted = index.where(_matches(F.col("token"), [s for _, s in phrases]))
    tagged = [F.when(F.startswith("token", F.lit(s)), F.struct(F.lit(k).alias("word"), F.lit(s).alias("phrase"))) for k, s in phrases]
    found = wanted.select("doc", "tf", F.explode(F.array_compact(F.array(*tagged))).alias("p")).groupBy("doc", "p.word", "p.phrase")
    found = found.agg(F.sum("tf").alias("tf"))
    length = index.groupBy("doc").agg(F.sum("tf").alias("len")) if lengths is None else lengths
    totals = length.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean"))
    n = found.groupBy("phrase").agg(F.countDistinct("doc").alias("n"))
    idf = F.greatest(F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    scored = found.join(n, "phrase").join(length, "doc").crossJoin(F.broadcast(totals)).withColumn("part", part)
    by = scored.groupBy("doc").agg(F.countDistinct("word").alias("words"), (-F.sum("part")).alias("score"))
    return by.where(F.col("words") == len(asked)).select("doc", "score")


def count_hits(index: DataFrame, question: str) -> DataFrame:
    """How many documents have every word; nothing is scored."""
    asked = question_words(question)
    if not asked:
        return index.select("doc").limit(0).agg(F.count(F.lit(1)).alias("documents"))
    says = [F.bool_or(_matches(F.col("token"), spellings)) for spellings in asked]
    has = index.where(_matches(F.col("token"), [s for spellings in asked for s in spellings])).groupBy("doc").agg(*[s.alias(f"w{k}") for k, s in enumerate(says)])
    return has.where(" and ".join(f"w{k}" for k in range(len(asked)))).agg(F.count(F.lit(1)).alias("documents"))


def found(rows: DataFrame, index: DataFrame | None, question: str, id_col: str, text_col: str, limit: int = 20, offset: int = 0, scored: DataFrame | None = None) -> DataFrame:
    """A page of what a question finds, best first: place, the columns of rows, score, snippet and `total`,
    how many there are.  Ties go by id.  No row has a place if nothing is found.
    `scored` is what hits() gave, if it is there already."""
    scored = (hits(index, question) if scored is None else scored).select(F.col("doc").alias("_doc"), "score")
    total = scored.agg(F.count(F.lit(1)).alias("total"))
    page = scored.orderBy("score", "_doc").offset(offset).limit(limit)
    place = F.row_number().over(Window.orderBy("score", "_doc")) + offset  # of `limit` rows
    placed = page.withColumn("place", place)
    spellings = [s for w in question_words(question) for s in w]
    shown = rows.join(F.broadcast(placed), rows[id_col] == F.col("_doc")).drop("_doc")
    return shown.withColumn("snippet", snippet(F.col(text_col), fold(F.col(text_col)), spellings)).crossJoin(F.broadcast(total))


def indicators_matching(names: DataFrame, question: str) -> DataFrame:
    """(indicator_id, said): tests of which one folded name holds every word of the question, each as the
    beginning of a word; names(indicator_id, name).  `said` is the shortest such name."""
    held = F.concat(F.lit(" "), F.array_join(words(fold(F.col("name"))), " "))
    fits = F.lit(True)
    for spellings in question_words(question):
        any_of = F.lit(False)
        for s in spellings:
            any_of = any_of | F.contains(held, F.lit(f" {s}"))
        fits = fits & any_of
    if not question_words(question):
        fits = F.lit(False)
    return names.where(fits).groupBy("indicator_id").agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("said"))


def keep_index(index: DataFrame, path: str, lengths: DataFrame | None = None) -> None:
    """Write postings by the first two letters of their tokens, and the documents' lengths beside them.  Letters
    that very many tokens begin with are dealt to several tasks and files.

    The index may be row_postings(): it is dealt once, and rows of one document and token are
    summed where they are then.
    """
    dealt = index.withColumns({"head": F.substring("token", 1, 2), "part": F.pmod(F.xxhash64("doc"), F.lit(16))}).repartition("head", "part")
    summed = dealt.groupBy("head", "part", "doc", "token").agg(F.sum("tf").alias("tf")).drop("part")
    summed.select("doc", "token", "tf", "head").write.mode("overwrite").partitionBy("head").parquet(f"{path}/postings")
    lengths = index.groupBy("doc").agg(F.sum("tf").alias("len")) if lengths is None else lengths
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")


def kept_hits(spark: SparkSession, path: str, question: str) -> DataFrame:
    """hits() of a kept index: only the partitions of the question's words are read."""
    postings_kept, lengths = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")
    spellings = [s for w in question_words(question) for s in w]
    heads = F.lit(False)
    for s in spellings:
        heads = heads | (F.col("head") == s[:2] if len(s) > 1 else F.startswith("head", F.lit(s)))
    return hits(postings_kept.where(heads).drop("head"), question, lengths)
