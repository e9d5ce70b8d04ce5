"""The prefix trie against a plain one, on awkward and random conversations."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import conversations as C
from folioscope.llm.conversations import grafted, lengths_of, numbered_turns, prefix_trie

FIELDS = "conv_id long, turn long, role string, text string"
NAMES = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def told(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [x[1:] for x in sorted(turns)] for c, turns in by.items()}


def stemmed(turns):
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in turns}
    return {c: turns.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[: heads[c]] + own[heads[c] :] for c, own in turns.items()}


def plain_trie(paths):
    """Every prefix of every conversation."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = set()
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    for node, convs in members.items():
        below = [other for other in members if other[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in convs if len(paths[c]) == len(node))))
        out.add(
            (
                min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids[node]), sum(not kids[other] for other in below),
                sum((len(members[other]) - 1) * len(other[-1][1]) for other in below if other), hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return out


def as_set(out):
    rows = [tuple(r[c] for c in NAMES) for r in out.collect()]
    assert len(rows) == len(set(rows)) and out.columns == NAMES
    return set(rows)


def both(spark, rows):
    table = spark.createDataFrame(rows, FIELDS)
    turns = numbered_turns(table)
    assert as_set(prefix_trie(lengths_of(turns), turns)) == plain_trie(told(rows))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    got = as_set(prefix_trie(*grafted(turns, F.col("conv_id") - F.col("conv_id") % 100, heads, most=5)))
    assert got == plain_trie(stemmed(told(rows)))


def conversation(c, *texts):
    return [(c, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]


def test_copies_prefixes_and_turnless(spark):
    rows = [r for c in range(12) for r in conversation(c, *"abcdefgh"[: c % 5 + 1])]
    rows += [r for c in range(100, 108) for r in conversation(c, "a", "b", "x" * (c % 3), "tail", "end")]
    rows += conversation(1007, "only") + conversation(-5, "a", "z") + conversation(-105, "a")
    both(spark, rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None, None, None), (1, None, "user", "a"), (1, 0, "user", None), (2, None, "", ""), (2, None, "user", "a"), (2, 0, "user", ""), (None, 1, "user", "no id")]
    rows += [(3, 5, "user", "same")] * 4 + [(4, 5, "user", "same")] * 3 + [(5, 7, "b", "tie"), (5, 7, "a", "tie"), (6, 7, "a", "tie"), (6, 8, "b", "tie")]
    rows += [(7, 0, "ab", "c"), (8, 0, "a", "bc"), (9, 0, "1:a", "b")]
    both(spark, rows)


def test_one_and_none(spark):
    both(spark, conversation(200, "a", "b"))
    both(spark, conversation(7, "a"))
    empty = numbered_turns(spark.createDataFrame([], FIELDS))
    out = prefix_trie(lengths_of(empty), empty)
    assert out.count() == 0 and out.columns == NAMES
    both(spark, [(None, 0, "user", "x")])


def test_long_conversations_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 7)
    monkeypatch.setattr(C, "IDS", 4)
    texts = [f"t{k}" * (k % 4) for k in range(60)]
    rows = [r for c in (100, 101, 105, 112, 113, 130, 131, 132, 199) for r in conversation(c, *texts)] + conversation(140, *texts[:3], "other") + conversation(141, "long " * 300_000)
    both(spark, rows)


def test_extra_columns_of_clashing_names(spark):
    rows = [r for c in range(5) for r in conversation(c, *"abc"[: c % 3 + 1])]
    table = spark.createDataFrame(rows, FIELDS).withColumns({c: F.lit(1) for c in ("pos", "digest", "chars", "at", "node", "g", "w", "n_turns")})
    turns = numbered_turns(table)
    assert as_set(prefix_trie(lengths_of(turns), turns)) == plain_trie(told(rows))


@pytest.mark.parametrize("stride", [1, 50])
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.lists(st.sampled_from(["", "a", "b", "cc"]), min_size=1, max_size=5), min_size=1, max_size=9))
def test_random(spark, stride, data):
    both(spark, [r for k, texts in enumerate(data) for r in conversation(stride * k, *texts)])
