"""SimHash near-dedup with pivot distance tables."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, slices, staged, text_or_empty, utf8, word_bounds, word_hashes
from .components import smallest_reachable

SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, width: int = 3) -> int:
    """64 bits: bit b is set if over half of the shingles' XXH64 values have it.  No word: zero."""
    words = text.translate(_LOWER).split()  # bytes.split() cuts at exactly space and 0x09-0x0D
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return votes(np.fromiter((digest(join(words[i : i + width]), SEED) for i in range(n)), np.uint64, n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """id, fp (the 64 bits as a signed long), tie (a hash of the text), one row per input row.  Null
    text has no word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            marks = np.array([fingerprint(x.encode(), width) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64)), batch.column(2)], ["id", "fp", "tie"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    return rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, fp long, tie long")


#: References of the key and of the discarding, the same in every task.
KEY_REFS, PIVOTS = 10, 16


def pivots(count: int, seed: int = 7) -> np.ndarray:
    """Reference fingerprints, the same in every task."""
    return np.random.default_rng(seed).integers(0, 1 << 64, count, np.uint64)


def pivot_table(marks: np.ndarray, refs: np.ndarray, part: np.uint64 | None = None) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference, in all bits or those of `part`."""
    apart = marks[:, None] ^ refs[None, :]
    return np.bitwise_count(apart if part is None else apart & part).astype(np.int16)


def parts_of(free: int, near: int) -> list[tuple[int, int]]:
    """The bits of the mask `free` in near + 2 parts, two at a time, as pairs of masks: `near` bits
    spoil at most `near` parts, so two fingerprints that near agree on both masks of some pair."""
    places = [b for b in range(64) if free >> b & 1]
    masks = [sum(1 << b for b in chunk.tolist()) for chunk in np.array_split(np.array(places, int), near + 2)]
    return [(x, y) for k, x in enumerate(masks) for y in masks[k + 1 :]]


def _deal(near: int):
    """(band, used, fp) -> a row for each pair of parts of the bits not yet used: a new band, which the old
    one and the distances of the two parts to KEY_REFS references decide, and the bits used now."""
    refs = pivots(KEY_REFS, seed=11)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band, used, marks = (batch.column(k).to_numpy().view(np.uint64) for k in range(3))
            for mask in np.unique(used):
                on = used == mask
                codes: dict[int, np.ndarray] = {}
                for k, pair in enumerate(parts_of(~int(mask) & (1 << 64) - 1, near)):
                    key = mixed(band[on] + np.uint64(k + 1))
                    for part in pair:
                        if part not in codes:
                            table = pivot_table(marks[on], refs, np.uint64(part)).astype(np.uint64)
                            codes[part] = (table << (6 * np.arange(KEY_REFS, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
                        key = mixed(key + codes[part])
                    now = np.full(len(key), mask | np.uint64(pair[0]) | np.uint64(pair[1]))
                    columns = [pa.array(x.view(np.int64)) for x in (key, now, marks[on])]
                    yield pa.RecordBatch.from_arrays(columns, ["band", "used", "fp"])

    return work


class _Forest:
    """Union-find over the few fingerprints of one band that have a partner."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def links_of_band(marks: np.ndarray, near: int, refs: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the pairs at `near` or fewer bits connect, and close no circle.

    Fingerprints are sorted by the distance to the first pivot; pairs whose distances to any pivot
    differ by more than `near` go; the rest are verified.
    """
    table = pivot_table(marks, refs)
    order = np.argsort(table[:, 0], kind="stable")
    marks, table = marks[order], table[order]
    ends = np.searchsorted(table[:, 0], table[:, 0] + near, "right")
    forest, links = _Forest(), []
    for i in np.flatnonzero(ends - np.arange(len(marks)) > 1).tolist():
        j = slice(i + 1, ends[i])
        close = np.flatnonzero(np.abs(table[j] - table[i]).max(axis=1) <= near)
        others = marks[j][close]
        for y in others[np.bitwise_count(others ^ marks[i]) <= near].tolist():
            if forest.join(x := int(marks[i]), y):
                links.append((x, y))
    return links


def _links(near: int):
    """Batches come sorted by band; a band may go on in the next batch."""
    refs = pivots(PIVOTS)

    def told(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.concatenate([[0], np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1, [len(rows)]]) if len(rows) else np.zeros(1, int)
        out: list[tuple[int, int]] = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a > 1:
                out += links_of_band(rows[a:b, 1].view(np.uint64), near, refs)
        if out:
            pairs = np.array(out, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, 2), np.int64)
        for batch in batches:
            rows = np.concatenate([kept, np.stack([batch.column(k).to_numpy() for k in range(2)], axis=1)])
            if len(rows):
                cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
                yield from told(rows[:cut])
                kept = np.ascontiguousarray(rows[cut:])
        yield from told(kept)

    return work


def near_links(marks: DataFrame, near: int = 2, most: int = 4_096) -> DataFrame:
    """Links (a, b) between different fingerprints at `near` or fewer differing bits.

    marks has one column fp of different fingerprints.  The links connect exactly the fingerprints
    that all such pairs connect, but a band of n fingerprints gives fewer than n of them.
    Pairs come from pivot distance tables.  Distances to a reference add up over parts of the bits,
    and near + 2 parts leave two unspoiled, in which all distances agree: so the distances of two
    parts to several references are the key of a band.  A band with more than `most` fingerprints
    is dealt again by the bits that its key has not used, before any task reads it, and again,
    until bands are small: few fingerprints agree on almost all bits.  Inside a band whole
    distances to other pivots discard and Hamming distance verifies.
    """
    if not 0 <= near <= 14:
        raise ValueError("near must be from 0 to 14")
    kind = "band long, used long, fp long"
    rows = marks.select(F.lit(0).cast("long").alias("band"), F.lit(0).cast("long").alias("used"), "fp")
    free, small = 64, []
    while True:
        rows = staged(rows.mapInArrow(_deal(near), kind), "simhash-bands")
        free -= 2 * -(-free // (near + 2))
        sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = staged(sizes.select("band", (F.col("n") > most).alias("large")), "simhash-sizes")
        last = free < near + 2 or not sizes.where("large").limit(1).count()
        met = rows.join(sizes if last else sizes.where("not large"), "band").select("band", "fp")
        small.append(met.repartition("band").sortWithinPartitions("band").mapInArrow(_links(near), "a long, b long"))
        if last:
            return functools.reduce(DataFrame.union, small).distinct()
        rows = rows.join(sizes.where("large").select("band"), "band").select("band", "used", "fp")


def _components(docs: DataFrame, id_col: str, text_col: str, near: int) -> DataFrame:
    """id, fp, tie, component_id, one row per input row."""
    rows = staged(fingerprints(docs, id_col, text_col), "simhash-rows")
    marks = staged(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-marks")
    nodes = marks.select(F.col("fp").alias("node"), F.col("least").alias("label"))
    label = smallest_reachable(nodes, near_links(marks, near))
    return rows.join(label.select(F.col("node").alias("fp"), F.col("label").alias("component_id")), "fp")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = 2) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id, kept.

    component_id is the smallest id reachable over links of `near` or fewer differing bits; rows
    with one fingerprint are linked.  Texts without a word (null, empty, blanks) have fingerprint
    zero and link like any other.  `kept` is true for the row that has that smallest id (for each
    if rows repeat it).  Null ids never become a component's id unless all of it are null.  Ids
    may be of any type with an order.
    """
    return _components(docs, id_col, text_col, near).select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def votes(hashes: np.ndarray) -> int:
    """The fingerprint of different shingle hashes: bit b is set if over half of them have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted, different hashes of its shingles of `width` words; of a shorter text, of all its words."""
    data, at = utf8(texts)
    data = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
    starts, ends, first = word_bounds(data, at)
    words = word_hashes(data, starts, ends)
    grams = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        grams = mixed(grams + words[k : k + len(grams)])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        else:
            whole = np.zeros(min(1, b - a), np.uint64)
            for word in words[a:b]:
                whole = mixed(whole + word)
            yield whole


def _mark(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def _common(texts: DataFrame, width: int, share: float = 0.125, least: int = 4, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles frequent in a sample, sorted, and how often they occur in it.  They come last in the
    order of shingles; any order gives the same links, so sample and limits decide the work alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(batch.column(0), width)])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["gram"])

    drawn = texts.where(F.pmod(F.xxhash64("id", "tie"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    counts = drawn.mapInArrow(work, "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    table = counts.orderBy(F.desc("n"), "gram").limit(most).toArrow()
    grams, often = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(grams)
    return grams[order], often[order]


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, sig, size, at) sorted by gram and sig -> the different rows of grams that several sigs have, and n, how many."""
    kept = np.zeros((0, 4), np.int64)

    def told(rows: np.ndarray) -> pa.RecordBatch:
        rows = rows[np.concatenate([[True], np.any(rows[1:, :2] != rows[:-1, :2], axis=1)])[: len(rows)]]
        cut = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])[: len(rows)])
        size = np.diff(np.append(cut, len(rows)))
        n = np.repeat(size, size)
        on = n > 1
        columns = [pa.array(rows[on, 0]), pa.array(rows[on, 1]), *(pa.array(rows[on, k].astype(np.int32)) for k in (2, 3)), pa.array(n[on])]
        return pa.RecordBatch.from_arrays(columns, ["gram", "sig", "size", "at", "n"])

    for batch in batches:
        rows = np.concatenate([kept, np.stack([batch.column(k).cast(pa.int64()).to_numpy() for k in range(4)], axis=1)])
        if len(rows):
            # The last gram may go on in the next batch.
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            yield told(rows[:cut])
            kept = rows[cut:]
    yield told(kept)


#: Grams of so many sets or more are first compared with one of them.
CROWD = 24
#: Differing bits up to which fingerprints propose a pair.
PROPOSED = 3


def similar_links(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, width: int = 5, crowd: int = CROWD, near: int = PROPOSED
) -> tuple[DataFrame, DataFrame]:
    """rows (id, tie, sig), one per input row, sig being a hash of the shingle set, and links (a, b)
    between sigs: they connect exactly what all pairs of Jaccard similarity >= `similarity` connect.

    1. SimHash: each shingle set has a fingerprint; near_links() proposes pairs at `near` or fewer
       bits, sets of one fingerprint are proposed with one of them, and pairs are compared whole.
    2. Fingerprints of sets as similar as 0.8 differ in about ten bits, more than any key can bear,
       so what is still apart goes through a lossless prefix filter: in any one order of all
       shingles, two sets that similar share k shingles among the first n - ceil(similarity * n) + k
       of each, for the smaller k of the two; here k is 1 + n // 20.  First the sets of crowded
       shingles are compared with one each, the most central, so that a large group of copies is
       linked at a cost of its size; then every pair that is still apart and may be similar by what
       is before and behind a shingle that both have, so that nothing is left out.
    """
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    texts = texts.withColumn("tie", F.xxhash64("text"))
    common, often = _common(texts, width)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = list(shingle_sets(batch.column(1), width))
            firsts = []
            for x in sets:
                rank = np.zeros(len(x), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, x), len(common) - 1)
                    rank = np.where(common[at] == x, often[at], 0)
                size = len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1 + len(x) // 20 if len(x) else 0
                firsts.append(x[np.argsort(rank, kind="stable")[:size]])
            sigs, marks = (pa.array(np.array([f(x) for x in sets], np.uint64).view(np.int64)) for f in (_mark, votes))
            sizes = pa.array(np.array([len(x) for x in sets], np.int32))
            columns = [batch.column(0), batch.column(2), sigs, marks, sizes, _lists(firsts)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "tie", "sig", "fp", "size", "first"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = list(shingle_sets(batch.column(0), width))
            sigs = np.array([_mark(x) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sigs), _lists(sets)], ["sig", "grams"])

    rows = staged(texts.mapInArrow(heads, f"id {kind}, tie long, sig long, fp long, size int, first array<long>"), "similar-rows")

    def checked(pairs: DataFrame) -> DataFrame:
        """Those of pairs(a, b) whose sets are similar."""
        ends = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
        ties = rows.join(ends, "sig", "left_semi").groupBy("sig").agg(F.min("tie").alias("tie"))
        sets = texts.select("text", "tie").join(staged(ties.select("tie"), "similar-ties"), "tie", "left_semi").dropDuplicates(["tie"]).select("text")
        sets = staged(sets.mapInArrow(whole, "sig long, grams array<long>").dropDuplicates(["sig"]), "similar-sets")
        full = pairs.join(sets.select(F.col("sig").alias("a"), F.col("grams").alias("grams_a")), "a")
        full = full.join(sets.select(F.col("sig").alias("b"), F.col("grams").alias("grams_b")), "b")
        same = F.size(F.array_intersect("grams_a", "grams_b"))
        return staged(full.where(same / (F.size("grams_a") + F.size("grams_b") - same) >= similarity).select("a", "b"), "similar-links")

    def sharing(x: DataFrame, y: DataFrame, on: Column, part: float) -> DataFrame:
        """Similar pairs among those that share `part` of the shingles that similar ones must."""
        small, large = F.least("x.size", "y.size"), F.greatest("x.size", "y.size")
        apart = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.part") != F.col("y.part")) & on & (small >= similarity * large - 1e-6)
        a, b = F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")
        pairs = x.alias("x").join(y.alias("y"), apart).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"), F.min(small).alias("small"))
        return checked(staged(pairs.where(F.col("n") >= part * (1 + F.floor(F.col("small") / 20))).select("a", "b"), "similar-pairs"))

    def labelled(what: DataFrame, label: DataFrame) -> DataFrame:
        """what(sig, ...) with `part`, that of label(node, label), or its sig."""
        label = label.select(F.col("node").alias("sig"), F.col("label").alias("part"))
        return what.join(label, "sig", "left").withColumn("part", F.coalesce("part", "sig"))

    def stars(links: DataFrame) -> DataFrame:
        """(node, label): the least node within two links, so nodes about one centre have one label.  Nodes
        of one label are connected, though not all that are connected have one."""
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        near = both.groupBy("node").agg(F.least("node", F.min("other")).alias("label"))
        far = both.join(near.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("label"))
        return staged(far, "similar-stars")

    sizes = rows.where("size > 0").groupBy("fp", "sig").agg(F.min("size").alias("size"))
    heads_of = staged(sizes.groupBy("fp").agg(F.min("sig").alias("head")), "similar-marks")
    own = sizes.join(heads_of, "fp").where("sig <> head").select(F.col("head").alias("a"), F.col("sig").alias("b"))
    other = near_links(heads_of, near).join(heads_of.select(F.col("fp").alias("a"), F.col("head").alias("head_a")), "a")
    other = other.join(heads_of.select(F.col("fp").alias("b"), F.col("head").alias("head_b")), "b")
    links = checked(staged(own.union(other.select("head_a", "head_b")), "similar-proposed"))

    dealt = rows.select(F.posexplode("first").alias("at", "gram"), "sig", "size").select("gram", "sig", "size", "at")
    dealt = dealt.repartition("gram").sortWithinPartitions("gram", "sig")
    met = staged(labelled(dealt.mapInArrow(_several, "gram long, sig long, size int, at int, n long"), stars(links)), "similar-met")
    crowded = met.where(F.col("n") >= crowd)
    # The hub of a shingle is its set with the largest share of crowded shingles: what a group of near copies
    # was made from has hardly any other, and is as near to all of them as a set can be.
    prefix = (F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-9) + 1 + F.floor(F.col("size") / 20)).cast("int")
    central = crowded.groupBy("sig").agg((F.count(F.lit(1)) / F.max(prefix)).alias("share"))
    ranked = F.struct(F.col("share"), F.xxhash64("sig").alias("draw"), "sig", "size", "part")
    hubs = crowded.join(central, "sig").groupBy("gram").agg(F.max(ranked).alias("hub"))
    links = links.union(sharing(crowded, hubs.select("gram", "hub.sig", "hub.size", "hub.part"), F.lit(True), 0.5))
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    label = staged(smallest_reachable(ends.select("node", F.col("node").alias("label")), links), "similar-labels")
    # Of what two sets share, the shingles before a common one are first shingles of both, and of those that others
    # have first as well; those behind it are at most what is left of either.
    before = F.row_number().over(Window.partitionBy("sig").orderBy("at")) - 1
    placed = labelled(met.drop("part"), label).select("gram", "sig", "size", "part", before.alias("before"), (F.col("size") - F.col("at") - 1).alias("behind"))
    apart = staged(placed, "similar-apart")
    several = apart.groupBy("gram").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    apart = apart.join(several.select("gram"), "gram", "left_semi")
    # A labelled node's link to its label stands for all links so far: few rounds are left to do.
    stars_so_far = label.where("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b"))
    least = lambda c: F.least(f"x.{c}", f"y.{c}")
    enough = least("before") + 1 + least("behind") + 1e-6 >= similarity / (1 + similarity) * (F.col("x.size") + F.col("y.size"))
    return rows.select("id", "tie", "sig"), stars_so_far.union(sharing(apart, apart, (F.col("x.sig") < F.col("y.sig")) & enough, 1.0))


def near_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, width: int = 5) -> DataFrame:
    """docs without near copies: one row of each component of similar_links, all columns.

    Texts without a word are copies of each other.  The row with the smallest id stays (a null id is
    larger than any); of rows that repeat it, the one with the least hash of the text, and of equal
    rows one.  Other columns may have any names; ids may be of any type with an order.
    """
    rows, links = similar_links(docs, id_col, text_col, similarity, width)
    nodes = rows.select(F.col("sig").alias("node"), F.col("sig").alias("label")).distinct()
    label = smallest_reachable(nodes, links).select(F.col("node").alias("sig"), "label")
    least = rows.groupBy("sig").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie")).alias("one"))
    winners = least.join(label, "sig").groupBy("label").agg(F.min("one").alias("one"))
    winners = staged(winners.select(F.col("one.id").alias("id"), F.col("one.tie").alias("same")), "similar-winners")
    names = {name: f"c{k}" for k, name in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()], F.xxhash64(text_or_empty(text_col)).alias("tie"))
    own = own.join(winners, F.col(names[id_col]).eqNullSafe(F.col("id")) & (F.col("tie") == F.col("same")), "left_semi")
    own = own.dropDuplicates([names[id_col], "tie"])
    return own.select(*[F.col(new).alias(old) for old, new in names.items()])
