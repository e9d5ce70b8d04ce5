from collections import Counter

import pyspark.sql.functions as F
import pytest

from folioscope.llm.mixing import mix_decisions, mix_sources, mixed_documents, packed, permuted, slot_plan, source_targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, block long, s string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, 1, 2, "x") for i, t, s in rows], SCHEMA)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permuted_is_a_permutation(spark, n):
    rows = spark.range(n).select(permuted(F.col("id"), F.lit(n), F.lit("k")).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(n))


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    spare, free = float(sum(sizes.values())), set(names)
    while spare > 1e-9 and free:
        share = {s: spare * weight[s] / sum(weight[x] for x in free) for s in free}
        spare = 0.0
        for s in list(free):
            target[s] += share[s]
            if target[s] >= 3 * sizes[s]:
                spare += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                free.discard(s)
    return target


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 10, "b": 1000, "c": 50_000, None: 7},
        {"a": 5, "b": 5, "c": 5, "d": 100_000, "é": 3, "z": 0},
        {"b": 900},
        {"x": 0},
        {"A": 1, "a": 100, "B": 100, "b": 10**7},
    ],
)
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in source_targets(frame).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], abs=1e-6)


def rows_of():
    rows = [(i, "w " * (i % 37) + "end", f"s{i % 4}") for i in range(400)]
    rows += [(None, "null id", None), (7, "twice", "s3"), (7, "twice", "s3"), (900, None, "s1"), (901, " \n", "s1"), (902, "", None)]
    rows += [(1000 + i, "long " * 4000, "hot") for i in range(8)]
    return rows


def test_mix_sources(spark):
    rows = rows_of()
    got = mix_sources(docs(spark, rows).repartition(5), block=16).collect()
    again = mix_sources(docs(spark, rows[::-1]).repartition(2), block=16).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(again, key=key)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        taken[r.target] += r.taken
        target[r.target] = r.target
    for t in target:
        assert abs(taken[t] - t) <= max(50, 0.02 * t)


def test_mixed_documents(spark):
    rows = [(i, f"a{i} b{i} c{i} " * 30, "x" if i % 3 else "y") for i in range(200)]
    frame = docs(spark, rows)
    taken = {r.doc_id: r.taken for r in mix_sources(frame, block=16).collect()}
    out = mixed_documents(frame, block=16)
    assert out.columns == frame.columns
    words = Counter()
    for r in out.collect():
        assert r.text and r.n_chars == len(r.text)
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({k: v for k, v in taken.items() if v})


def test_empty(spark):
    none = docs(spark, [])
    assert mix_sources(none).count() == 0 and mixed_documents(none).count() == 0


def test_small_sources_meet_their_targets(spark):
    rows = [(1, "w " * 40, "a"), (2, "w " * 130, "b"), (3, "w " * 3, "c"), (4, "w " * 200, "d"), (5, "w " * 55, "d"), (6, "w " * 5_000, "e"), (7, "x", None)]
    rows += [(10 + i, "w " * (i % 50), "f") for i in range(200)]
    got = mix_sources(docs(spark, rows)).collect()
    taken, target = Counter(), {}
    source = {i: s for i, _, s in rows}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size
    for s, words in target.items():
        assert abs(taken[s] - words) <= 0.5


def planned(spark, sizes, **options):
    frame = source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long"))
    return frame, slot_plan(frame, **options)


def test_slots_are_what_each_shard_drew(spark):
    sizes = {"a": 4_000, "b": 90_000, "c": 30_005, None: 17}
    block, shard_slots, seed = 16, 256, 3
    targets, plan = planned(spark, sizes, block=block, shard_slots=shard_slots, seed=seed)
    rows = plan.collect()
    words = {r.source: round(r.target) for r in targets.collect()}
    names = ["a", "b", "c", None]
    slots, blocks = {}, {}
    for s in names:
        passes, over = divmod(words[s], sizes[s])
        blocks[s] = -(-sizes[s] // block)
        slots[s] = passes * blocks[s] + -(-over // block)
    every = sum(slots.values())
    # The draw, slot by slot.
    place = spark.range(every).select("id", F.pmod(F.xxhash64(F.lit("draw"), F.lit(seed), "id"), F.lit(every)).alias("p")).collect()
    drawn = {s: [] for s in names}
    for r in sorted(place):
        at, k = r.p, 0
        while at >= slots[names[k]]:
            at, k = at - slots[names[k]], k + 1
        drawn[names[k]].append(r.id // shard_slots)
    last = -(-every // shard_slots)
    for s in names:
        own = sorted((r for r in rows if r.source == s), key=lambda r: r.slot)
        want = (drawn[s] + [last] * slots[s])[: slots[s]]
        assert [r.slot for r in own] == list(range(slots[s])) and [r.shard for r in own] == want
        for at in range(0, slots[s], blocks[s]):
            once = [r.block for r in own[at : at + blocks[s]]]
            assert len(set(once)) == len(once) and set(once) <= set(range(blocks[s]))
        taken = sum(min(block, sizes[s] - r.block * block) if not r.short else r.rest for r in own)
        assert taken == words[s]


def test_the_draw_decides(spark):
    sizes = {"a": 40_000, "b": 90_000, "c": 30_000}
    blocks = lambda **o: {(r.source, r.block) for r in planned(spark, sizes, block=16, **o)[1].collect() if r.source == "b"}
    first = blocks(shard_slots=512)
    assert first == blocks(shard_slots=512) and first != blocks(shard_slots=512, seed=1) and first != blocks(shard_slots=300)


def test_taken_is_by_word(spark):
    """Against words laid end to end and blocks cut out of them."""
    rows, block = rows_of(), 16
    frame = docs(spark, rows)
    plain = frame.select("source", F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"),
                         F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \n]+"), lambda w: w != "")).cast("long").alias("size"))
    times = {}
    for r in slot_plan(source_targets(plain), block, 64).collect():
        for w in range(r.block * block, r.block * block + (r.rest if r.short else block)):
            times[r.source, w] = times.get((r.source, w), 0) + 1
    want = Counter()
    ends = {}
    for r in packed(plain).collect():
        taken = sum(times.get((r.source, w), 0) for w in range(r.start, r.start + r["size"]))
        want[r.source, r.id, r["size"], taken] += 1
        ends.setdefault(r.source, []).append((r.start, r.start + r["size"]))
    for spans in ends.values():
        spans = sorted(s for s in spans if s[0] < s[1])
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    got = mix_decisions(frame, block=block, shard_slots=64).collect()
    assert Counter((r.source, r.id, r["size"], r.taken) for r in got) == want
    for r in got:
        for p in r.pieces or ():
            assert len(p.shards) == p.times + (p.more > p.low) or p.more == p.low


def test_many_equal_rows_and_clashing_names(spark):
    columns = "doc_id long, text string, source string, pieces int, _s int, _i int, words int, copy int, tie int, id int, same int"
    rows = [(5, "a b c", "s", 1, 2, 3, 4, 5, 6, 7, 8)] * 9_000 + [(6, "d e", "t", 1, 2, 3, 4, 5, 6, 7, 8), (None, None, None, *[None] * 8)]
    frame = spark.createDataFrame(rows, columns)
    got = mix_sources(frame).collect()
    assert len(got) == 9_002 and sum(r.taken for r in got) == 27_002
    out = mixed_documents(frame)
    assert out.columns == frame.columns and {tuple(r)[3:] for r in out.collect()} == {(1, 2, 3, 4, 5, 6, 7, 8)}
