"""Mixing sources to target weights, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANK, staged, text_or_empty

#: What btrim takes off: the characters that part words.
_BLANKS = " \t\n\x0b\x0c\r"
WEIGHTS = (5, 2, 1)
_ROUNDS = 24
MOST_SOURCES = 100_000


def words_in(text: Column) -> Column:
    """The words of a text as an array; a text without words has none."""
    inner = F.btrim(text, F.lit(_BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK))


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """Where a pseudorandom permutation of 0 .. n-1, chosen by key, sends index.

    Swap-or-not (Hoang, Morris and Rogaway, 2012): exact for every n, with no table and no walk.
    """

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *key), n) - x, n)
        high = F.greatest(x, other)
        return F.when(F.pmod(F.xxhash64(high, r, *key), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), index.cast("long"), swap)


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """rows(source, size) -> source, source_size, target: one row per source.

    Sources in order of code points, null last, take the weights in turn and share the sum of all
    sizes; no target is above `most` times its source's size, and what is cut off is shared again
    by weight.  The shares settle where target = least(most * size, level * weight); sorted by
    most * size / weight, the sources that the level passes come first, so running sums give it.
    The windows here see one row per source, and the plan of the mix is made of them, so more than
    MOST_SOURCES sources are an error.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    sizes = sizes.withColumn("weight", weight.cast("double"))
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    sizes = (
        sizes.withColumn("cap", (most * F.col("source_size")).cast("double"))
        .withColumn("reach", left / F.sum("weight").over(after))
        .withColumn("level", F.max(F.when(F.col("reach") <= F.col("cap") / F.col("weight"), F.col("reach"))).over(every))
    )
    target = F.least(F.col("cap"), F.col("level") * F.col("weight"))
    return sizes.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def slot_plan(sources: DataFrame, block: int = 128, shard_slots: int = 1 << 14, seed: int = 0) -> DataFrame:
    """source_targets() -> (source, slot, shard, block, short, rest): which block each slot of the mix
    takes, and the output shard that the slot lies in; a `short` slot takes only the first `rest`
    words of its block.

    The mix is cut into output shards of `shard_slots` slots.  Each slot draws its source, with the
    targets as odds, so a shard's source counts are one multinomial draw.  A source's slots are
    those that it drew, shard after shard; what it drew beyond its target is cut off at the end,
    and what it is short of goes into one more shard, so that its words sum up to the rounded
    target exactly, however few they are.
    Whole passes over a source send its slots through a permutation of its blocks, a new one each
    pass, so no block is taken more than one time oftener than another.  In the last, unfinished
    pass the blocks are shared out among the shards by what each drew, and a shard's slots go
    through a permutation of its share: the draw decides which blocks are taken once more.  That
    pass leaves an unfilled last block for the end.
    """
    spark = sources.sparkSession
    plan = (
        sources.withColumn("words", F.round("target").cast("long"))
        .where("words > 0")
        .withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
        .withColumn("filled", F.floor(F.col("source_size") / block).cast("long"))
        .withColumn("passes", F.floor(F.col("words") / F.col("source_size")).cast("long"))
        .withColumn("over", F.col("words") % F.col("source_size"))
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("over") / block).cast("long"))
        .select("source", "blocks", "filled", "passes", "over", "slots")
    )
    rows = plan.orderBy(F.col("source").asc_nulls_last()).collect()  # source_targets() bounds their number
    if not rows:
        return plan.select("source", *[F.lit(0).cast("long").alias(c) for c in ("slot", "shard", "block")], F.lit(False).alias("short"), F.lit(0).cast("long").alias("rest"))
    known = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], T.StructType([T.StructField("which", T.IntegerType()), *plan.schema.fields]))
    edges = [0]
    for r in rows:
        edges.append(edges[-1] + r["slots"])
    every, shards = edges[-1], -(-edges[-1] // shard_slots)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.pmod(F.xxhash64(F.lit("draw"), F.lit(seed), "id"), F.lit(every))
    drawn = (
        spark.range(0, every, 1, tasks)
        .select(F.floor(F.col("id") / shard_slots).cast("long").alias("shard"), _interval(place, edges[1:]).alias("which"))
        .groupBy("which", "shard")
        .agg(F.count(F.lit(1)).alias("drawn"))
    )
    drawn = staged(drawn, "mix-drawn")
    before = Window.partitionBy("which").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = drawn.withColumn("begin", F.coalesce(F.sum("drawn").over(before), F.lit(0)))
    sums = drawn.groupBy("which").agg(F.sum("drawn").alias("sum"))
    short = known.join(F.broadcast(sums), "which", "left").withColumn("sum", F.coalesce("sum", F.lit(0))).where("sum < slots")
    short = short.select("which", F.lit(shards).cast("long").alias("shard"), (F.col("slots") - F.col("sum")).alias("drawn"), F.col("sum").alias("begin"))
    runs = runs.unionByName(short).join(F.broadcast(known), "which").withColumn("end", F.least(F.col("begin") + F.col("drawn"), "slots")).where("begin < end")
    # The last pass: positions first .. last of this shard among `most`, and its share of the blocks.
    start = F.col("passes") * F.col("blocks")
    most = F.least(F.col("filled"), F.col("slots") - start)
    first, last = F.least(F.greatest(F.col("begin") - start, F.lit(0)), most), F.least(F.col("end") - start, most)
    wide = lambda c: c.cast("decimal(19,0)")
    share = lambda c: F.call_function("div", wide(c) * wide(F.col("filled")), wide(F.greatest(most, F.lit(1)))).cast("long")
    runs = runs.withColumns({"first": first, "low": share(first), "high": share(last)})
    # A run of a small mix may be long, and runs are few: cut them before they are exploded.
    runs = runs.withColumn("from", F.explode(F.sequence("begin", F.col("end") - 1, F.lit(4096).cast("long"))))
    runs = runs.repartition(tasks, "which", "from")
    slots = runs.withColumn("j", F.explode(F.sequence("from", F.least(F.col("from") + 4095, F.col("end") - 1))))

    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    turn, at = F.floor(F.col("j") / F.col("blocks")), F.col("j") % F.col("blocks")
    slots = slots.withColumns({"turn": turn, "at": at})
    among = permuted(F.col("at") - F.col("first"), F.col("high") - F.col("low"), F.lit("share"), F.lit(seed), source, F.col("shard"))
    slots = slots.withColumn(
        "within", F.when(F.col("turn") < F.col("passes"), F.col("at")).when(F.col("at") < F.col("filled"), F.col("low") + among).otherwise(F.lit(-1))
    )
    count = F.when(F.col("turn") < F.col("passes"), F.col("blocks")).otherwise(F.col("filled"))
    dealt = permuted(F.col("within"), count, F.lit("blocks"), F.lit(seed), source, F.col("turn"))
    rest = F.col("over") % block
    return slots.select(
        "source",
        F.col("j").alias("slot"),
        "shard",
        F.when(F.col("within") < 0, F.col("at")).otherwise(dealt).alias("block"),
        ((F.col("j") == F.col("slots") - 1) & (rest > 0)).alias("short"),
        rest.alias("rest"),
    )


def _interval(place: Column, ends: list[int]) -> Column:
    """How many of the ascending `ends` are not above `place`: a binary search."""
    known, n = F.array(*map(F.lit, ends)).cast("array<bigint>"), len(ends)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])

    def halve(low: Column, step: Column) -> Column:
        return F.when((low + step <= n) & (F.get(known, low + step - 1) <= place), low + step).otherwise(low)

    return F.aggregate(steps, F.lit(0), halve)


def taken_blocks(sources: DataFrame, block: int = 128, shard_slots: int = 1 << 14, seed: int = 0) -> DataFrame:
    """slot_plan() by block: (source, block, times, part, shards): how often the mix takes a block, how many
    of its first words once more, and the output shards of these slots, one for each time."""
    full = ~F.col("short")
    return (
        slot_plan(sources, block, shard_slots, seed)
        .groupBy("source", "block")
        .agg(
            F.count_if(full).alias("times"),
            F.max(F.when(F.col("short"), F.col("rest")).otherwise(0)).alias("part"),
            F.array_sort(F.collect_list(F.when(full, F.col("shard")))).alias("shards"),
            F.max(F.when(F.col("short"), F.col("shard"))).alias("part_shard"),
        )
        .select("source", "block", "times", "part", F.when(F.col("part") > 0, F.array_append("shards", F.col("part_shard"))).otherwise(F.col("shards")).alias("shards"))
    )


def packed(rows: DataFrame, bucket_rows: int = 2_000) -> DataFrame:
    """rows(source, id, tie, size) -> the same rows with `start`, the words of the source before the row,
    and (bucket, row, copy), unique in a source.

    The order in a source is that of a hash of id and tie, then id, tie and size.  No task sums a
    whole source: sums by bucket of the hash give where each bucket begins.  Rows equal in all four
    are counted first and dealt out again at the end, so many of them fill no bucket.
    """
    kinds = rows.groupBy("source", "id", "tie", "size").agg(F.count(F.lit(1)).alias("copies"))
    buckets = max(1, -(-rows.count() // bucket_rows))
    cut = staged(kinds.withColumn("bucket", F.pmod(F.xxhash64("id", "tie", F.lit(11)), F.lit(buckets))), "mix-kinds")
    sums = cut.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("begin")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("id", "tie", "size")
    placed = cut.withColumn("row", F.row_number().over(inside)).withColumn(
        "inside", F.sum(F.col("size") * F.col("copies")).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    )
    joined = placed.join(begins, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    joined = joined.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(4096).cast("long"))))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = joined.repartition(tasks, "source", "bucket", "row", "from")
    dealt = dealt.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + 4095, F.col("copies") - 1))))
    start = F.col("begin") + F.coalesce("inside", F.lit(0)) + F.col("copy") * F.col("size")
    return dealt.withColumn("start", start).drop("s", "b", "begin", "inside", "from", "copies")


def mix_decisions(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = 3,
    block: int = 128,
    shard_slots: int = 1 << 14,
    seed: int = 0,
) -> DataFrame:
    """One row per input row: id, tie (a hash of its text), source, size, source_size, target, taken, pieces.

    size is the number of words (null text: 0); taken counts the words the mix takes, repeats
    counted; pieces has (low, more, high, times, shards) of its words, by block: words low .. high
    are taken `times` times, those below `more` once more, in these output shards.  A null source
    is a source of its own.  Rows that repeat an id are rows like any other.  Texts without a word
    are taken 0 times.  The same rows and seed give the same result, in any order and partitioning.
    """
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(source_col).alias("source"),
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("tie"),
        F.size(words_in(text)).cast("long").alias("size"),
    )
    rows = staged(rows, "mix-rows")
    sources = staged(source_targets(rows, weights, most).coalesce(1), "mix-sources")
    if sources.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    placed = staged(packed(rows), "mix-packed")
    blocks = taken_blocks(sources, block, shard_slots, seed).withColumnRenamed("source", "s").withColumnRenamed("block", "b")
    spans = placed.where("size > 0").withColumn(
        "b0",
        F.explode(
            F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
        ),
    )
    # Spark takes the exploded slots for as small as the table of sources, and would broadcast them.
    met = spans.join(blocks.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("b0") == F.col("b")))
    low = F.greatest(F.col("b0") * block - F.col("start"), F.lit(0))
    high = F.least((F.col("b0") + 1) * block - F.col("start"), F.col("size"))
    more = F.least(F.col("b0") * block + F.col("part") - F.col("start"), high)  # words before it once more
    met = met.withColumn("low", low).withColumn("high", high).withColumn("more", F.greatest(low, more))
    taken = met.groupBy("source", "bucket", "row", "copy").agg(
        F.sum(F.col("times") * (F.col("high") - F.col("low")) + F.col("more") - F.col("low")).alias("taken"),
        F.collect_list(F.struct("low", "more", "high", "times", "shards")).alias("pieces"),
    )
    taken = taken.withColumnsRenamed({"source": "s", "bucket": "b", "row": "r", "copy": "c"})
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")) & (F.col("row") == F.col("r")) & (F.col("copy") == F.col("c"))
    wide = placed.join(taken, same, "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    total = sources.select(F.col("source").alias("s2"), "source_size", "target")
    return wide.join(total, F.col("source").eqNullSafe(F.col("s2"))).select(
        "id", "tie", "source", "size", "source_size", "target", "taken", F.array_sort("pieces").alias("pieces")
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken.  See mix_decisions."""
    rows = mix_decisions(docs, id_col, **options)
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3, **options) -> DataFrame:
    """The mix itself, in the columns of docs: up to `most` rows for each input row, the n-th with
    the words that the mix takes at least n times, joined by one space.

    Rows with nothing taken go.  If n_chars is among the columns, it is counted anew.  Rows that
    repeat one source, id and text get the decision of the first of them.
    """
    source = options.get("source_col", "source")
    names = {name: f"c{k}" for k, name in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()], F.xxhash64(text_or_empty(text_col)).alias("tie"))
    rows = mix_decisions(docs, id_col, text_col, most=most, **options).where("taken > 0")
    rows = rows.dropDuplicates(["source", "id", "tie"]).select("source", "id", F.col("tie").alias("same"), "pieces")
    met = own.join(
        rows, F.col(names[source]).eqNullSafe(F.col("source")) & F.col(names[id_col]).eqNullSafe(F.col("id")) & (F.col("tie") == F.col("same"))
    )
    part = lambda words, a, b: F.slice(words, (a + 1).cast("int"), (b - a).cast("int"))

    def copy(n: Column) -> Column:
        runs = F.transform(
            F.col("pieces"),
            lambda p: part(
                F.col("words"), p["low"], F.when(p["times"] >= n, p["high"]).when(p["times"] == n - 1, p["more"]).otherwise(p["low"])
            ),
        )
        return F.concat_ws(" ", F.flatten(runs))

    copies = F.transform(F.array(*[F.lit(n + 1) for n in range(most)]), copy)
    out = met.withColumn("words", words_in(text_or_empty(names[text_col]))).withColumn("copy", F.explode(F.filter(copies, lambda c: c != "")))
    made = {text_col: F.col("copy")} | ({"n_chars": F.length("copy").cast("long")} if "n_chars" in docs.columns else {})
    return out.select(*[made.get(old, F.col(new)).alias(old) for old, new in names.items()])
