"""The prefix trie of conversations, by partition refinement.

All conversations start in one class; each round splits the classes that hold different conversations
by their next turn.  A class with one conversation left (with its exact copies, which are one from
the start) is retired: what follows of it is a unary chain and needs no more rounds.  Sizes of
subtrees are folded back from the deepest round to the root.  A round moves a key of each conversation
that is still active, never its texts, and no class or conversation is gathered in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Turns whose characters are summed in one window, and ids that are joined in one string.
BLOCK, IDS = 10_000, 65_536


def numbered_turns(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos from 1, digest of role and text, chars of the text), in the order of turn, null first.

    Null role and text are empty; equal turns come by role, then text.  Rows without a conv_id are no
    conversation and go.  Rows are sorted by ranges, so that one conversation may fill many tasks;
    each range then counts on from those before it.
    """
    said = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    dealt = said.repartitionByRange(*order).sortWithinPartitions(*order)
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    at = F.monotonically_increasing_id()  # the partition, and above it the row in it
    rows = staged(dealt.select("conv_id", at.alias("at"), digest.alias("digest"), F.length("text").cast("long").alias("chars")), "turns")
    part = F.shiftright("at", 33).alias("part")
    runs = rows.groupBy("conv_id", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    met = rows.withColumn("part", part).join(runs, ["conv_id", "part"])
    return met.select("conv_id", (F.col("before") + F.col("at") - F.col("first") + 1).alias("pos"), "digest", "chars")


def lengths_of(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns)."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))


def grafted(turns: DataFrame, stem: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) in which each conversation's first `heads` turns (at most `most`) are replaced by
    those of the conversation `stem`: all it has if that is fewer, none if it is absent.

    Both are expressions of conv_id.  A conversation that has nothing beyond its first turns, and
    whose stem is absent, is left without a turn.
    """
    own = lengths_of(turns).select("conv_id", "n_turns", stem.alias("stem"), heads.cast("long").alias("h"))
    stems = own.select(F.col("conv_id").alias("stem"), F.least("n_turns", F.lit(most)).alias("there"))
    plan = staged(own.join(stems, "stem", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))), "grafts")
    first = turns.where(F.col("pos") <= most).withColumnRenamed("conv_id", "stem")
    head = plan.select("conv_id", "stem", "taken").join(first, "stem").where(F.col("pos") <= F.col("taken"))
    tail = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where(F.col("pos") > F.col("h"))
    rows = head.select("conv_id", "pos", "digest", "chars").union(tail.select("conv_id", F.expr("pos - h + taken"), "digest", "chars"))
    return plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("n_turns")), staged(rows, "grafted")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of convs(conv_id, n_turns) with turns(conv_id, pos, digest, chars).

    A node is a sequence of turns that a conversation starts with, the root the empty one.  Returns
    conv_id (smallest of the conversations that start so), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves (childless nodes at or below it), saved_tokens (over it and all
    below, n_convs - 1 times the characters of the last turn: what storing the turn once saves) and
    ends_sha256 (of the ids of the conversations that end in it, ascending, comma-joined).  The last
    turn of a node is turn `depth` of its conv_id.

    Conversations without a turn end at the root.  No conversations: no rows.  Two different
    conversations pass for copies with odds of 2**-128.
    """
    mark = [F.bit_xor(F.xxhash64(*names)).alias(k) for k, names in (("a", ("pos", "digest")), ("b", ("digest", "pos")))]
    whole = convs.join(turns.groupBy("conv_id").agg(*mark), "conv_id", "left")
    copies = staged(whole.select("conv_id", "n_turns", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")), "marks")
    groups = staged(copies.groupBy("n_turns", "a", "b").agg(F.min("conv_id").alias("g"), F.count(F.lit(1)).alias("w")), "groups")
    total = groups.agg(F.min("g").alias("node"), F.sum("w").alias("n_convs"), F.count(F.lit(1)).alias("n_groups")).first()
    nodes = "node long, cls long, n_convs long, n_groups long, chars long"
    spark = convs.sparkSession
    root = spark.createDataFrame([(total.node, None, total.n_convs, total.n_groups, 0)] if total.n_groups else [], nodes)
    own = groups.select(F.col("g").alias("conv_id"))
    path = staged(turns.join(own, "conv_id").select(F.col("conv_id").alias("g"), "pos", "digest", "chars").sortWithinPartitions("pos"), "paths")

    # Refinement: levels[d] are the nodes at depth d, active the conversations of those that still split.
    levels, splits, ended = [root], total.n_groups > 1, []
    active = groups.select("g", "w", "n_turns", F.lit(total.node).cast("long").alias("cls"))
    while splits:
        depth = len(levels)
        ended.append(active.where(F.col("n_turns") == depth - 1).select("g", "cls"))
        steps = path.where(F.col("pos") == depth).join(active.where(F.col("n_turns") >= depth), "g")
        kids = steps.groupBy("cls", "digest").agg(
            F.min("g").alias("node"), F.sum("w").alias("n_convs"), F.count(F.lit(1)).alias("n_groups"), F.max("chars").alias("chars")
        )
        kids = staged(kids, "classes")
        levels.append(kids.select("node", "cls", "n_convs", "n_groups", "chars"))
        alive = kids.where("n_groups > 1").select("cls", "digest", "node")
        splits = not alive.isEmpty()
        if splits:
            active = staged(steps.join(alive, ["cls", "digest"]).select("g", "w", "n_turns", F.col("node").alias("cls")), "active")

    # Unary chains: what follows a retired class.
    leaves = [level.where("n_groups = 1").select(F.col("node").alias("g"), F.lit(depth).cast("long").alias("from")) for depth, level in enumerate(levels)]
    retired = _union(leaves).join(groups.select("g", "w", "n_turns"), "g")
    chains = staged(path.join(retired, "g").where(F.col("pos") > F.col("from")), "chains")
    tails = staged(chains.groupBy("g").agg(F.sum("chars").alias("tail")), "tails")

    # Fold back.
    folded, below = [], None
    for depth in reversed(range(len(levels))):
        rows = levels[depth].join(tails.withColumnRenamed("g", "node"), "node", "left")
        if below is None:
            rows = rows.withColumns({c: F.lit(None).cast("long") for c in ("n_kids", "kid_leaves", "kid_saved")})
        else:
            rows = rows.join(below.groupBy(F.col("cls").alias("node")).agg(F.count(F.lit(1)).alias("n_kids"), F.sum("n_leaves").alias("kid_leaves"), F.sum("saved_tokens").alias("kid_saved")), "node", "left")
        single = F.col("n_groups") == 1
        saved = F.col("n_convs") - 1
        below = staged(
            rows.select(
                "node", "cls", "n_convs",
                F.when(single, F.col("tail").isNotNull().cast("long")).otherwise(F.col("n_kids")).alias("n_children"),
                F.when(single, F.lit(1).cast("long")).otherwise(F.col("kid_leaves")).alias("n_leaves"),
                (saved * F.col("chars") + F.when(single, saved * F.coalesce("tail", F.lit(0))).otherwise(F.col("kid_saved"))).alias("saved_tokens"),
            ),
            "folded",
        )
        folded.append(below.withColumn("depth", F.lit(depth).cast("long")))
    unary = _with_rest(chains).select(
        F.col("g").alias("node"), F.col("g").alias("cls"), F.col("w").alias("n_convs"), (F.col("pos") < F.col("n_turns")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("w") - 1) * F.col("rest")).alias("saved_tokens"), F.col("pos").alias("depth"),
    )
    every = _union(folded).unionByName(unary)

    # Ends: all that end in a node are copies of each other.
    ends = groups.join(_digests(copies, groups), "g")
    if ended:
        ends = ends.join(_union(ended), "g", "left")
    else:
        ends = ends.withColumn("cls", F.lit(None).cast("long"))
    ends = ends.select(F.coalesce("cls", "g").alias("node"), F.col("n_turns").alias("depth"), "ends_sha256")
    return every.join(ends, ["node", "depth"], "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("cls").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _with_rest(chains: DataFrame) -> DataFrame:
    """chains with the characters from each turn to the conversation's end, summed by blocks of turns."""
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    inside = Window.partitionBy("g", "block").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("g").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = chains.groupBy("g", block).agg(F.sum("chars").alias("n"))
    sums = sums.select("g", "block", F.coalesce(F.sum("n").over(after), F.lit(0)).alias("after"))
    rows = chains.withColumn("block", block).join(sums, ["g", "block"])
    return rows.withColumn("rest", F.sum("chars").over(inside) + F.col("after"))


def _digests(copies: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, ends_sha256): the SHA-256 of each group's ids.

    Of a group of one it is native.  The ids of larger ones are joined in strings of bounded length,
    each in a task of its own, and one task streams a group's strings, in order, through the hash.
    """
    alone = groups.where("w = 1").select("g", F.sha2(F.col("g").cast("string"), 256).alias("ends_sha256"))
    many = copies.join(groups.where("w > 1").select("n_turns", "a", "b", "g"), ["n_turns", "a", "b"])
    strings = many.groupBy("g", F.floor(F.col("conv_id") / IDS).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return alone.union(strings.repartition("g").sortWithinPartitions("g", "part").mapInArrow(_hashed, "g long, ends_sha256 string"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest for each run of equal g."""
    now, digest = None, None

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], names=["g", "ends_sha256"])

    for batch in batches:
        for g, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if digest is not None and g == now:
                digest.update(b",")
            else:
                if digest is not None:
                    yield made()
                now, digest = g, hashlib.sha256()
            digest.update(ids.encode())
    if digest is not None:
        yield made()
