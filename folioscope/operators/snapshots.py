"""Snapshots of a table that can be compared without gathering them: digests by ranges of keys, in a tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges of keys, and how many digests of one level a digest of the next is made of.
LEAVES, FAN = 256, 16


def edges(rows: DataFrame, keys: list[str], leaves: int = LEAVES) -> DataFrame:
    """(edges): one row, the keys at which a table is cut into about equal ranges, LEAVES at most.  Taken
    from one table and used for all that are compared with it; any edges give right answers."""
    key = F.struct(*keys)
    drawn = rows.select(key.alias("key"), F.xxhash64(*keys).alias("draw")).orderBy("draw", "key").limit(20 * leaves)  # of each task the least
    placed = drawn.withColumn("place", F.ntile(min(leaves, LEAVES)).over(Window.orderBy("key")))  # of a bounded sample
    least = placed.groupBy("place").agg(F.min("key").alias("key"))
    return least.agg(F.array_sort(F.collect_set("key")).alias("edges"))


def digests(rows: DataFrame, keys: list[str], edges: DataFrame) -> DataFrame:
    """(level, place, n, digest): level 0 has a digest for each range of keys, in their order; each further
    level has one for every FAN of the last, up to the root.

    A range's digest is made of sums over its rows, so the order of rows in it does not matter, equal
    rows count, and each task adds up its own before anything is shuffled.  What counts as equal is
    what grouping takes as equal (0.0 and -0.0 are), if the tables' columns are of one type.
    """
    told = [x for f in sorted(rows.schema, key=lambda f: f.name) for x in (F.col(f.name).isNull(), _hashable(f))]
    hashed = rows.withColumns({"_one": F.xxhash64(F.lit(1), *told), "_two": F.xxhash64(F.lit(2), *told)})
    # Two pieces of 26 bits of each hash, whose sums overflow at 2^37 rows of one range, not before.
    pieces = [F.shiftrightunsigned(h, by).bitwiseAND(2**26 - 1) for h in ("_one", "_two") for by in (38, 12)]
    met = _placed(hashed, keys, edges).select("place", *[p.alias(f"_sum{k}") for k, p in enumerate(pieces)])
    sums = met.groupBy("place").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"_sum{k}").alias(f"_sum{k}") for k in range(len(pieces))])
    level = sums.select(F.lit(0).alias("level"), "place", "n", F.sha2(F.concat_ws("|", "n", *[f"_sum{k}" for k in range(len(pieces))]), 256).alias("digest"))
    levels, width = [level], LEAVES
    while width > 1:
        width = -(-width // FAN)
        told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: F.concat_ws(":", x["place"], x["digest"])), ",")
        level = level.groupBy(F.floor(F.col("place") / FAN).cast("int").alias("place")).agg(F.sum("n").alias("n"), F.sha2(told, 256).alias("digest"))
        level = level.select(F.lit(len(levels)).alias("level"), "place", "n", "digest")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def _hashable(field: T.StructField) -> Column:
    """A column as it goes into a row's hash: as it is, whole numbers as one type; nested values as they print."""
    column, kind = F.col(field.name), field.dataType
    if isinstance(kind, T.IntegralType):
        return column.cast("long")
    if isinstance(kind, T.FloatType):
        return column.cast("double")
    plain = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return column if isinstance(kind, plain) else column.cast("string")


def _placed(rows: DataFrame, keys: list[str], edges: DataFrame) -> DataFrame:
    """rows with `place`, the range of a row's key: the last edge not above it, found by halving.  Each step is
    a column, and the key is made once, so that all is compiled: what is computed beside it in one
    stage must stay short, for the JVM does not compile long methods."""
    step = LEAVES // 2
    out = rows.withColumn("_key", F.struct(*keys)).crossJoin(F.broadcast(edges)).withColumn("place", F.lit(0))  # one row
    while step:
        held = F.coalesce(F.get("edges", F.col("place") + step) <= F.col("_key"), F.lit(False)).cast("int")
        out, step = out.withColumn("place", F.col("place") + held * step), step // 2
    return out.drop("edges", "_key")


def first_difference(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """keys, in_one, in_other: the first key, in the order of keys, whose rows differ, and how many rows each
    table has of it; no row if the tables are alike.

    Both are digested by the same ranges; only the rows between the edges of the first range that
    differs are looked at.  Columns of two types are compared as the type that holds both.
    """
    both = one.unionByName(other)
    one, other = (t.select(*[F.col(f.name).cast(f.dataType) for f in both.schema]) for t in (one, other))
    cut = edges(both, keys)
    a, b = (digests(t, keys, cut).where("level = 0").select("place", "digest") for t in (one, other))
    differs = a.join(b.withColumnRenamed("digest", "theirs"), "place", "full").where(~F.col("digest").eqNullSafe(F.col("theirs")))
    first = differs.agg(F.min("place").alias("_first")).where("_first is not null")
    ends = cut.crossJoin(F.broadcast(first)).select(F.when(F.col("_first") > 0, F.get("edges", F.col("_first"))).alias("_from"), F.get("edges", F.col("_first") + 1).alias("_to"))
    columns, key = sorted(one.columns), F.struct(*keys)
    inside = (F.col("_from").isNull() | (key >= F.col("_from"))) & (F.col("_to").isNull() | (key < F.col("_to")))
    sides = [t.join(F.broadcast(ends), inside).select(*columns, F.lit(sign).alias("_side")) for t, sign in ((one, 1), (other, -1))]
    rows = sides[0].unionByName(sides[1]).groupBy(*columns).agg(F.sum("_side").alias("_more"), F.count_if(F.col("_side") > 0).alias("_ours"), F.count_if(F.col("_side") < 0).alias("_theirs"))
    by_key = rows.groupBy(*keys).agg(F.max(F.col("_more") != 0).alias("_differ"), F.sum("_ours").alias("in_one"), F.sum("_theirs").alias("in_other"))
    return by_key.where("_differ").orderBy(*keys).limit(1).select(*keys, "in_one", "in_other")
