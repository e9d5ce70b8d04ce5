import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest
import xxhash

from folioscope.llm.components import smallest_reachable
from folioscope.llm.exact_dedup import exact_dedup
from folioscope.llm.sharding import jump, numbered, shard_documents, write_shards
from folioscope.llm.simhash import fingerprint, near_dedup, near_unique

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, salt int, id long"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None, "x", 1, 5) for i, t in zip(ids, texts)], SCHEMA)


TEXTS = ["a", "b", "a", None, "", "A", "b " * 30_000, "b " * 30_000, "a", "é", "é"]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    digest = {"digest": lambda text: F.length(text).cast("string")} if weak else {}
    rows = exact_dedup(docs(spark, TEXTS).repartition(3), **digest).collect()
    assert len(rows) == len(TEXTS)
    plain = [t or "" for t in TEXTS]
    for r in rows:
        same = [i for i, t in enumerate(plain) if t == plain[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))
        assert r.text_sha256 == hashlib.sha256(plain[r.doc_id].encode()).hexdigest()


def test_exact_dedup_repeated_and_null_ids(spark):
    rows = exact_dedup(docs(spark, ["x", "x", "x", "y"], [3, 3, None, None])).collect()
    assert sorted((r.keep_id or -1, r.group_size, r.kept) for r in rows) == [(-1, 1, True), (3, 3, False), (3, 3, True), (3, 3, True)]


def test_empty_tables(spark):
    none = docs(spark, [])
    for f in (exact_dedup, shard_documents, near_dedup):
        assert f(none).count() == 0


def one_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.random.default_rng(1).integers(0, 2**64, 2000, np.uint64)
    for n in (1, 2, 24, 25, 1000):
        assert jump(keys, n).tolist() == [one_jump(int(k), n) for k in keys]
    moved = jump(keys, 24) != jump(keys, 25)
    assert set(jump(keys, 25)[moved]) == {24} and moved.mean() < 0.06


def test_shard_documents(spark):
    texts = [None, "", "é"] + [f"text {i}" for i in range(500)] + ["twice", "twice"]
    ids = [None, *range(len(texts) - 3), 7, 7]
    rows = shard_documents(docs(spark, texts, ids).repartition(5)).collect()
    assert len(rows) == len(texts)
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert all(r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24 and r.law == "key" for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[1].size, by_id[1].text_crc32) == (10, zlib.crc32("é".encode()))
    assert (by_id[None].size, by_id[None].text_crc32) == (8, 0)


def test_numbered_in_many_buckets(spark):
    rows = numbered(spark.range(1000).withColumn("g", F.col("id") % 3), "g", bucket_rows=10).collect()
    for g in range(3):
        assert sorted(r.slot for r in rows if r.g == g) == list(range(sum(r.g == g for r in rows)))
    same = spark.range(5000).select(F.lit(None).cast("long").alias("id"), F.when(F.col("id") < 4900, 1).alias("bucket"))
    rows = numbered(same, "bucket", bucket_rows=10, run=64).collect()
    assert sorted(r.slot for r in rows if r.bucket) == list(range(4900)) and sorted(r.slot for r in rows if not r.bucket) == list(range(100))


def test_write_shards(spark, tmp_path):
    frame = docs(spark, ["a"] * 50)
    write_shards(frame, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
    with pytest.raises(ValueError, match="shard_col"):
        write_shards(frame.withColumn("shard", F.lit(1)), str(tmp_path / "other"))
    write_shards(frame.withColumn("shard", F.lit(1)), str(tmp_path / "other"), shard_col="part")
    assert spark.read.parquet(str(tmp_path / "other")).where("shard = 1").count() == 50


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint(spark):
    for text in ["", " \n", "One", "one two", "One two THREE", "a b c d a b c", "x\x1cy z w É é   q", "w " * 20_000 + "v"]:
        assert fingerprint(text.encode()) == plain_fingerprint(text)
    first = spark.createDataFrame([("one two three",)], "t string").select(F.expr("xxhash64(t)")).first()[0]
    assert fingerprint(b"one two three") == first % 2**64


def plain_components(marks):
    least = {}
    todo = set(range(len(marks)))
    while todo:
        queue = [min(todo)]
        seen = {queue[0]}
        while queue:
            x = queue.pop()
            for y in list(todo - seen):
                if (marks[x] ^ marks[y]).bit_count() <= 2:
                    seen.add(y)
                    queue.append(y)
        least |= dict.fromkeys(seen, min(seen))
        todo -= seen
    return least


def test_near_dedup_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, n)) for n in (0, 1, 40, 300, 300, 800, 2000)]
    texts = [None, "", " ", "The", "the"]
    for text in base:
        for k in range(12):
            words = text.split()
            for at in rng.integers(0, max(1, len(words)), k % 4 if len(words) else 0):
                words[at] = f"new{rng.integers(0, 99)}"
            texts.append(" ".join(words))
    rows = near_dedup(docs(spark, texts).repartition(4)).collect()
    marks = [plain_fingerprint(t) for t in texts]
    want = plain_components(marks)
    assert len(set(want.values())) < len(set(marks))  # links between different fingerprints occur
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{m:016x}", want[i]) for i, m in enumerate(marks)}
    assert Counter(r.kept for r in rows)[True] == len(set(want.values()))


def test_links_of_fingerprints(spark):
    from folioscope.llm.simhash import near_links

    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 64, 20, np.uint64).tolist()
    marks = sorted({c ^ (1 << int(a)) ^ (1 << int(b)) for c in centres for a, b in rng.integers(0, 64, (40, 2))} | {0, 3, 5, 2**64 - 1})
    signed = [m - 2**64 if m >= 2**63 else m for m in marks]
    frame = spark.createDataFrame([(m,) for m in signed], "fp long")
    links = near_links(frame)
    for r in links.collect():
        assert ((r.a ^ r.b) % 2**64).bit_count() <= 2
    nodes = spark.createDataFrame([(m, i) for i, m in enumerate(signed)], "node long, label long")
    got = {r.node: r.label for r in smallest_reachable(nodes, links).collect()}
    want = plain_components(marks)
    assert got == {m: want[i] for i, m in enumerate(signed)}


def test_components_of_a_long_chain(spark):
    nodes = spark.range(200).select(F.col("id").alias("node"), (F.col("id") + 1000).alias("label"))
    links = spark.range(199).where("id <> 120").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.node: r.label for r in smallest_reachable(nodes, links).collect()}
    assert got == {i: 1000 if i <= 120 else 1121 for i in range(200)}


@pytest.mark.parametrize(("near", "most"), [(0, 4096), (1, 5), (2, 5), (3, 20), (5, 50)])
def test_links_at_other_distances_and_in_split_bands(spark, near, most):
    """Against all pairs; small `most` deals bands again and again."""
    from folioscope.llm.simhash import near_links

    rng = np.random.default_rng(near)
    marks = set(rng.integers(0, 1 << 64, 30, np.uint64).tolist())
    for centre in list(marks)[:6]:
        for _ in range(30):
            marks.add(centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, near + 3)), replace=False)))
    marks |= {int(x) for x in rng.integers(0, 1 << 20, 60)}  # share the upper 44 bits
    marks = sorted(marks)
    signed = [m - 2**64 if m >= 2**63 else m for m in marks]
    links = near_links(spark.createDataFrame([(m,) for m in signed], "fp long"), near, most)
    nodes = spark.createDataFrame([(m, i) for i, m in enumerate(signed)], "node long, label long")
    got = {r.node: r.label for r in smallest_reachable(nodes, links).collect()}
    up = list(range(len(marks)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for j in range(len(marks)):
        for i in range(j):
            if (marks[i] ^ marks[j]).bit_count() <= near:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    assert got == {m: root(i) for i, m in enumerate(signed)}


def test_a_hot_band_is_split(spark):
    """200 000 fingerprints agree on half of their bits: no task gets all of them."""
    from folioscope.llm.simhash import near_links

    rng = np.random.default_rng(8)
    low = np.unique(rng.integers(0, 1 << 32, 200_000, np.uint64))
    table = pa.table({"fp": low.view(np.int64)})
    links = near_links(spark.createDataFrame(table.to_pandas()), 2)
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in links.collect()}
    known = set(low.tolist())
    flips = [1 << i for i in range(32)] + [1 << i | 1 << j for i in range(32) for j in range(i)]
    want = set()
    for f in flips:
        other = low ^ np.uint64(f)
        at = np.minimum(np.searchsorted(low, other), len(low) - 1)
        want |= {(min(x, y), max(x, y)) for x, y in zip(low[low[at] == other].tolist(), other[low[at] == other].tolist())}
    assert known and got <= want
    nodes = {x for p in want for x in p}
    assert {x for p in got for x in p} == nodes


def test_ids_of_other_types(spark):
    rows = [("b", "one two three four"), ("a", "One two three FOUR"), (None, "x"), ("c", "else")]
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup(frame).collect()}
    assert got["b"] == ("a", False) and got["a"] == ("a", True) and got["c"] == ("c", True)
    assert sorted(r.doc_id or "" for r in near_unique(frame).collect()) == ["", "a", "c"]
    out = shard_documents(frame, 24).collect()
    assert {r.doc_id for r in out} == {"a", "b", "c", None} and len({(r.shard, r.slot) for r in out}) == 4


def test_clashing_names(spark):
    rows = [(1, "a b c d e f g", "K", "H", "n", 5, 6), (2, "A b c d e f g", "k", "h", "n", 5, 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key string, hash string, none string, sig long, tie int")
    assert [tuple(r) for r in near_unique(frame).collect()] == [rows[0]]
