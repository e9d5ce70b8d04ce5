"""Sharding by jump consistent hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, staged, text_or_empty


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key (Lamping and Veach, 2014): no table of shards, and with one
    shard more a key stays or goes to the new shard."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state, shard = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    ahead = np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        shard[live] = ahead[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[live] = ((shard[live] + 1) * step).astype(np.int64)
        live = live[ahead[live] < shards]
    return shard


def jump_column(key: Column, shards: int) -> Column:
    """The shard of a long key; a null key counts as 0."""

    @F.pandas_udf("int")
    def shard_of(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in keys:
            spread = mixed(part.to_numpy(np.int64).view(np.uint64))
            yield pd.Series(jump(spread, shards).astype(np.int32))

    return shard_of(F.coalesce(key, F.lit(0)).cast("long"))


def key_of(docs: DataFrame, id_col: str) -> Column:
    """What decides the shard of an id: whole numbers themselves, of other types a 64-bit hash; null is null."""
    whole = dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    return F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))


def numbered(rows: DataFrame, group: str, bucket_rows: int = 20_000, run: int = 4_096) -> DataFrame:
    """rows with `slot`: 0, 1, 2 ... in each group without a gap, in order of a hash of all columns.

    No task sorts a whole group: a group is cut into buckets by the hash, about `bucket_rows` rows
    each; counts by bucket, far fewer rows, give where each bucket begins.  Equal rows are counted
    first and dealt out at the end, in runs of `run`, so a row that is there very often fills no
    bucket.  The columns are of types that can be grouped.
    """
    names = rows.columns
    keys = [f"k{k}" for k in range(len(names))]
    own = rows.select(*[F.col(f"`{old}`").alias(new) for old, new in zip(names, keys)])
    key = keys[names.index(group)]
    kinds = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).withColumn("hash", F.xxhash64(*keys, F.lit(7)))
    kinds = staged(kinds, "numbered-kinds")
    buckets = max(1, -(-kinds.count() // bucket_rows))
    cut = kinds.withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    counts = cut.groupBy(key, "bucket").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.withColumnsRenamed({key: "g", "bucket": "b"}).select("g", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy(key, "bucket").orderBy("hash", *keys)
    placed = cut.withColumn("ahead", F.coalesce(F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.join(begins, F.col(key).eqNullSafe(F.col("g")) & (F.col("bucket") == F.col("b")))
    placed = placed.withColumn("first", F.col("begin") + F.col("ahead"))
    step = F.lit(run).cast("long")
    placed = placed.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, step)))
    if kinds.where(F.col("copies") > run).limit(1).count():
        placed = placed.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "first", "from")
    placed = placed.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + step, "copies") - 1)))
    return placed.select(*[F.col(new).alias(old) for old, new in zip(names, keys)], (F.col("first") + F.col("copy")).cast("long").alias("slot"))


def shard_documents(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: the id and the number of shards decide, nothing else, so equal ids (and null
    ids among themselves, as id 0) share a shard.  Ids may be of any type that Spark can hash.
    size is the text's UTF-8 bytes plus 8; null text has size 8 and checksum 0, as the empty text.
    slot numbers the rows of a shard from 0 without a gap; the same rows give the same slots.
    grown_shard is the shard if there were one more: the same, or the new one.
    """
    raw = text_or_empty(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"),
        key_of(docs, id_col).alias("key"),
        (F.length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    rows = rows.select(
        "id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        jump_column(F.col("key"), shards).alias("shard"),
        jump_column(F.col("key"), shards + 1).alias("grown_shard"),
    )
    rows = numbered(rows, "shard")
    return rows.select(
        F.col("id").alias(id_col), "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def write_shards(
    docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", pieces: int = 16, shard_col: str = "shard"
) -> None:
    """Write docs as path/<shard_col>=K/, whole rows; each shard is written by up to `pieces` tasks, whatever
    ids repeat.  A column of docs that is called shard_col is an error: name another."""
    if shard_col in docs.columns:
        raise ValueError(f"docs have a column {shard_col}; name another with shard_col")
    shard = jump_column(key_of(docs, id_col), shards)
    piece = F.pmod(F.xxhash64(id_col, text_col, F.lit(3)), F.lit(pieces))
    docs.withColumn(shard_col, shard).repartition(F.col(shard_col), piece).write.partitionBy(shard_col).parquet(path)
