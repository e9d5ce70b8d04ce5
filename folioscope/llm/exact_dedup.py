"""Exact dedup, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_or_empty


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def copy_groups(rows: DataFrame, salts: int = 16) -> DataFrame:
    """One row for each different content of rows(id, digest, content): digest, content, keep_id, group_size.

    Three combining stages, each grouping by digest AND content: inside each input task (Spark's
    partial aggregate); across tasks, in `salts` parts a digest; across the parts.  A task hands on
    one row a content at most, so a group with a third of all rows reaches each reducer as a few
    rows.
    """
    kept = [F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    merged = [F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")]
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    return salted.groupBy("digest", "content", "salt").agg(*kept).groupBy("digest", "content").agg(*merged)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_hex, salts: int = 16
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as the empty text.  Of equal texts the largest id stays; of rows that repeat
    that id as well, each is `kept`.  A null id never wins over another; a group of null ids keeps
    null.  Other columns of docs are ignored.  An empty table gives an empty result.

    Rows meet their group by digest alone where the combining stages, which compare contents, have
    seen one content only under that digest.  Where a digest stands for several contents, its rows
    are joined by digest and content.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), digest(text_or_empty(text_col)).alias("digest"), text_or_empty(text_col).alias("content")
    )
    groups = staged(copy_groups(rows, salts).select("digest", "keep_id", "group_size"), "dedup-groups")
    if groups.groupBy("digest").count().where("count > 1").limit(1).count():
        return _by_content(rows, salts, id_col)
    return _result(rows.select("id", "digest").join(groups.where("group_size > 1"), "digest", "left"), id_col, F.col("digest"))


def _by_content(rows: DataFrame, salts: int, id_col: str) -> DataFrame:
    groups = staged(copy_groups(rows, salts).where("group_size > 1"), "dedup-contents")
    return _result(rows.join(groups, ["digest", "content"], "left"), id_col, sha256_hex(F.col("content")))


def _result(wide: DataFrame, id_col: str, sha: Column) -> DataFrame:
    keep = F.when(F.col("group_size") > 1, F.col("keep_id")).otherwise(F.col("id"))
    return wide.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        sha.alias("text_sha256"),
    )
