"""Substring dedup: passages that repeat, by compressed FM-indexes of shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mixed, range_hashes, slices, staged, text_or_empty, utf8, word_bounds, word_hashes

WINDOW = 35  # words
ANCHOR = 8  # words of the sequences that decide a window's shard
SPLIT = 4_096  # an anchor with more different fragments is dealt to several shards
LEVELS = 5  # so often by parts of its windows, then by whole windows
LAST, FIRST, MIDDLE = range(3)


class Bits:
    """Packed bits with rank: how many are set before a place."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)])

    def rank(self, places: np.ndarray) -> np.ndarray:
        word = places >> 6
        below = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[word] + np.bitwise_count(self.words[word] & below)


class WaveletTree:
    """Rank over a sequence of integers, one packed bit vector for each bit of the alphabet (the
    wavelet matrix of Claude, Navarro and Ordonez, 2015)."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        now = symbols
        for level in range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            self.levels.append((level, Bits(bit), int(len(bit) - bit.sum())))
            now = np.concatenate([now[~bit], now[bit]])

        self.begins = self._down(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _down(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.rank(places)
            places = np.where(symbols >> level & 1, zeros + ones, places - ones)
        return places

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        return self._down(symbols, ends) - self.begins[symbols]


class FmIndex:
    """A compressed FM-index of texts over integers 1 .. alphabet-1, each ended by 0, for patterns of up
    to `depth` symbols.

    What is kept of the Burrows-Wheeler transform are its runs, few where texts repeat: a wavelet
    tree of the runs' symbols, where runs begin, and their lengths summed up symbol by symbol.
    """

    def __init__(self, symbols: np.ndarray, alphabet: int, depth: int = 64) -> None:
        n = len(symbols)
        # Sort the suffixes by their first `depth` symbols at least: by a few at once, then doubling
        # what is compared, among those only that are still tied.  A rank is the place of the first
        # of equals; the order of ties does not matter for patterns of up to `depth` symbols.
        length = min(n, max(1, 62 // int(alphabet).bit_length()))
        key = np.zeros(n, np.int64)
        for k in range(length):
            key <<= int(alphabet).bit_length()
            key[: n - k] += symbols[k:]
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        first = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
        while length < depth:
            tied = np.flatnonzero(~(first & np.append(first[1:], True)))
            if not len(tied):
                break
            rows = order[tied]
            later = np.where(rows + length < n, rank[np.minimum(rows + length, n - 1)] + 1, 0)
            key = rank[rows] * (n + 1) + later
            by_key = np.argsort(key)
            rows, key = rows[by_key], key[by_key]
            order[tied] = rows
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first[tied] = new
            rank[rows] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
            length *= 2
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))])
        last = symbols[order - 1]
        new = np.concatenate([[True], last[1:] != last[:-1]])
        self.starts, self.runs = np.flatnonzero(new), Bits(new)
        self.heads = last[self.starts]
        self.tree = WaveletTree(self.heads, alphabet)
        by_symbol = np.argsort(self.heads, kind="stable")
        self.lengths = np.concatenate([[0], np.cumsum(np.diff(np.append(self.starts, n))[by_symbol])])
        self.first_run = np.searchsorted(self.heads[by_symbol], np.arange(alphabet))
        self.size, self.depth = n, depth

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each end."""
        run = self.runs.rank(np.minimum(ends + 1, self.size)) - 1
        first = self.first_run[symbols]
        whole = self.lengths[first + self.tree.rank(symbols, run)] - self.lengths[first]
        return whole + np.where(self.heads[run] == symbols, ends - self.starts[run], 0)

    def matching_lengths(self, symbols: np.ndarray, ends: np.ndarray, longest: int | np.ndarray) -> np.ndarray:
        """Matching statistics: for each end, how many of the symbols before it, `longest` at most,
        occur at least twice in the index.  Backward search, all ends side by side."""
        most = np.broadcast_to(longest, len(ends))
        if len(ends) and most.max() > self.depth:
            raise ValueError(f"the index is for patterns of up to {self.depth} symbols")
        out = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        step = 0
        while len(live):
            at = ends[live] - 1 - step
            on = (at >= 0) & (most[live] > step)
            live, symbol = live[on], symbols[at[on]]
            live, symbol = live[symbol > 0], symbol[symbol > 0]
            if step:
                both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
                new_low, new_high = self.before[symbol] + both[: len(live)], self.before[symbol] + both[len(live) :]
            else:
                new_low, new_high = self.before[symbol], self.before[symbol + 1]
            on = new_high - new_low >= 2
            live = live[on]
            low[live], high[live] = new_low[on], new_high[on]
            step += 1
            out[live] = step
        return out


def lowest_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost least value in each `width` values in a row."""
    n = len(values) - width + 1
    best, at = values.copy(), np.arange(len(values))
    have = 1
    while have < width:
        step = min(have, width - have)
        other, other_at = best[step:], at[step:]
        take = other < best[: len(other)]
        best, at = np.where(take, other, best[: len(other)]), np.where(take, other_at, at[: len(other)])
        have += step
    return at[:n]


def fragments(words: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Cut each text's windows into runs that share their anchor: text, first word, windows, anchor hash.

    A window's anchor is the least-hashed of its sequences of `anchor` words, the leftmost of
    equals: what is in the window alone decides it, so equal windows have equal anchors.  Every
    window lies in one fragment, and a fragment holds no other windows.
    """
    if len(words) < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    places = np.arange(len(words) - anchor + 1)
    marks = range_hashes(words, places, places + anchor)
    at = lowest_in_windows(marks, window - anchor + 1)
    starts = np.arange(len(at))
    whole = text[starts] == text[starts + window - 1]
    starts, at = starts[whole], at[whole]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    begins = np.flatnonzero(new)
    counts = np.diff(np.append(begins, len(starts)))
    return text[starts[begins]], starts[begins], counts, marks[at[begins]]


def _words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = utf8(texts)
    starts, ends, first = word_bounds(data, at)
    return word_hashes(data, starts, ends), first


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


FRAGMENT = "anchor long, content long, row long, tie long, start int, windows int"
WORDS = "anchor long, content long, twice boolean, heavy boolean, words array<long>"
VERDICT = "anchor long, content long, low int, high int"


def _cut(window: int, anchor: int):
    """(row, tie, text) -> fragments: hashes of the anchor and the content, place and number of windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, first = _words_of(batch.column(2))
            text, start, count, mark = fragments(words, first, window, anchor)
            content = range_hashes(words, start, start + count + window - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(mark),
                    _signed(content),
                    *(pa.array(batch.column(k).to_numpy()[text]) for k in range(2)),
                    pa.array((start - first[text]).astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                ],
                ["anchor", "content", "row", "tie", "start", "windows"],
            )

    return work


def _lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a list column end to end, and where each list begins."""
    first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    return lists.flatten().to_numpy().view(np.uint64), first


def _recut(window: int, anchor: int, level: int):
    """(anchor, content, twice, words) -> fragments of fragments: another hash of word sequences decides
    their anchors, so windows that shared one do so no longer unless they are alike elsewhere too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = _lists(batch.column(3))
            text, start, count, mark = fragments(mixed(words + np.uint64(level)), first, window, anchor)
            own = [batch.column(k).to_numpy(zero_copy_only=False)[text] for k in range(3)]
            mark = mixed(mark + own[0].view(np.uint64) * np.uint64(3))
            content = range_hashes(words, start, start + count + window - 1)
            columns = [_signed(mark), _signed(content), *map(pa.array, own), pa.array((start - first[text]).astype(np.int32)), pa.array(count.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "content", "in_anchor", "in_content", "twice", "start", "windows"])

    return work


def _fetch(window: int, source: str):
    """(two keys, text or words, wanted: array of (anchor, content, twice, heavy, start, windows)) -> the
    words of the wanted fragments.  A row with the keys of the one before it has been answered."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in slices(batches, source) if source == "text" else batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(2)], axis=1)
            new = np.concatenate([[before is None or bool((keys[0] != before).any())], (keys[1:] != keys[:-1]).any(axis=1)])[: len(keys)] if len(keys) else np.zeros(0, bool)
            before = keys[-1] if len(keys) else before
            batch = batch.filter(pa.array(new))
            words, first = _words_of(batch.column(2)) if source == "text" else _lists(batch.column(2))
            wanted = batch.column(3)
            row = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy())
            flat = wanted.flatten()
            start = flat.field("start").to_numpy().astype(np.int64)
            size = flat.field("windows").to_numpy().astype(np.int64) + window - 1
            at = np.repeat(first[row] + start - (np.cumsum(size) - size), size) + np.arange(size.sum())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), _signed(words[at]))
            names = ["anchor", "content", "twice", "heavy"]
            yield pa.RecordBatch.from_arrays([*map(flat.field, names), lists], [*names, "words"])

    return work


def repeated_in_shard(lists: list[np.ndarray], window: int, twice: list[bool] | None = None) -> list[np.ndarray]:
    """For each fragment's words: which of its windows occur at least twice among all of them; those
    marked `twice` stand for several copies.

    Fragments are streamed through the shard's index.  Where a window matches, the search goes on to
    the left, and all windows in the match are settled; where only its last k words do, so are all
    windows that hold these and the word before them.  A fragment's last window goes first, which
    settles copies; then its first, which settles most that only share an anchor; then middles.
    """
    size = np.array([len(x) for x in lists])
    again = np.flatnonzero(np.zeros(len(lists), bool) if twice is None else np.array(twice, bool))
    every = np.concatenate([*lists, *(lists[k] for k in again)])
    known, symbol = np.unique(every, return_inverse=True)
    sizes = np.concatenate([size, size[again]])
    ends = np.cumsum(sizes + 1)
    symbols = np.zeros(ends[-1], np.int64)
    symbols[np.arange(len(every)) + np.repeat(np.arange(len(sizes)), sizes)] = symbol + 1
    index = FmIndex(symbols, len(known) + 1, int(size.max()))
    counts = np.maximum(size - window + 1, 0)
    offset = np.cumsum(counts) - counts
    begin = ends[: len(lists)] - 1 - size
    edges = np.zeros(counts.sum() + 1, np.int64)
    # Windows not settled yet: fragment, from, to, and which of them goes next.
    which = np.flatnonzero(counts)
    low, high = np.zeros(len(which), np.int64), counts[which]
    turn = np.full(len(which), LAST)
    while len(which):
        at = np.select([turn == LAST, turn == FIRST], [high - 1, low], (low + high) // 2)
        length = index.matching_lengths(symbols, begin[which] + at + window, at + window - low)
        repeats = length >= window
        begins = np.where(repeats, at + window - length, at)  # what is settled, from here ..
        behind = np.where(repeats, at + 1, np.minimum(at + window - length, high))  # .. to here
        np.add.at(edges, (offset[which] + begins)[repeats], 1)
        np.add.at(edges, (offset[which] + behind)[repeats], -1)
        left = np.where(turn == LAST, FIRST, MIDDLE)
        right = np.where(repeats & (turn != LAST), MIDDLE, FIRST)
        some_left, some_right = low < begins, behind < high
        which, low, high, turn = (
            np.concatenate([x[some_left], y[some_right]]) for x, y in ((which, which), (low, behind), (begins, high), (left, right))
        )
    return np.split(np.cumsum(edges[:-1]) > 0, np.cumsum(counts)[:-1])


def _search(window: int, most_words: int):
    """Batches sorted by anchor and content: index as many whole anchors as make a shard, stream their
    fragments through the index, and give the runs of words that repeated windows cover."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int]] = []
        twice: list[bool] = []
        lists: list[np.ndarray] = []
        size = 0

        def answer() -> Iterator[pa.RecordBatch]:
            if not lists or (len(lists) == 1 and not twice[0]):
                return
            found = repeated_in_shard(lists, window, twice)
            counts = np.array([len(x) for x in found])
            flat = np.zeros(counts.sum() + len(counts) + 1, np.int8)
            place = np.cumsum(counts + 1) - counts  # one zero before each fragment, one at the end
            flat[np.repeat(place - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())] = np.concatenate(found)
            edge = np.diff(flat)
            low, high = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
            which = np.searchsorted(place, low, "right") - 1
            if len(which):
                own = np.array(keys)[which]
                columns = [own[:, 0], own[:, 1], (low - place[which]).astype(np.int32), (high - place[which] + window - 1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["anchor", "content", "low", "high"])

        for batch in batches:
            flat, first = _lists(batch.column(3))
            for i, (anchor, content, both) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                if keys and keys[-1] == (anchor, content):  # the same fragment of a repeated row
                    continue
                if size > most_words and keys[-1][0] != anchor:
                    yield from answer()
                    keys, twice, lists, size = [], [], [], 0
                keys.append((anchor, content))
                twice.append(both)
                lists.append(flat[first[i] : first[i + 1]].copy())
                size += len(lists[-1])
        yield from answer()

    return work


def _wanted(contents: DataFrame, split: int) -> DataFrame:
    """contents(anchor, content, n, one) of anchors that occur more than once, with what _fetch() asks for."""
    kinds = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all")).where(F.col("all") > 1)
    heavy = F.col("kinds") > split
    return contents.join(staged(kinds.select("anchor", "kinds"), "passages-kinds"), "anchor").select(
        "one.*", F.struct("anchor", "content", (F.col("n") > 1).alias("twice"), heavy.alias("heavy"), "one.start", "one.windows").alias("f")
    )


def _verdicts(words: DataFrame, window: int, anchor: int, split: int, shard_words: int, level: int) -> DataFrame:
    """WORDS -> VERDICT: for each fragment, named by anchor and content, the runs of words that windows
    cover which occur elsewhere too."""
    light = words.where("not heavy").select("anchor", "content", "twice", "words").repartition("anchor").sortWithinPartitions("anchor", "content")
    found = light.mapInArrow(_search(window, shard_words), VERDICT)
    heavy = words.where("heavy")
    if not heavy.limit(1).count():
        return found
    heavy = staged(heavy.select("anchor", "content", "twice", "words").dropDuplicates(["anchor", "content"]), "passages-heavy")
    kind = "anchor long, content long, in_anchor long, in_content long, twice boolean, start int, windows int"
    # Windows that go on sharing an anchor are at last dealt by all of their words: then equal windows alone
    # meet, and no anchor has more than one content.
    by = anchor if level < LEVELS else window
    parts = staged(heavy.mapInArrow(_recut(window, by, level), kind), "passages-parts")
    times = F.when(F.col("twice"), 2).otherwise(1)
    one = F.struct("in_anchor", "in_content", "start", "windows")
    contents = staged(parts.groupBy("anchor", "content").agg(F.sum(times).alias("n"), F.min(one).alias("one")), "passages-contents")
    wanted = _wanted(contents, split).groupBy("in_anchor", "in_content").agg(F.collect_list("f").alias("wanted"))
    whole = heavy.withColumnsRenamed({"anchor": "in_anchor", "content": "in_content"}).join(wanted, ["in_anchor", "in_content"])
    deeper = whole.select("in_anchor", "in_content", "words", "wanted").mapInArrow(_fetch(window, "words"), WORDS)
    inner = _verdicts(staged(deeper, "passages-words"), window, anchor, split, shard_words, level + 1)
    placed = parts.join(staged(inner, "passages-verdicts"), ["anchor", "content"])
    low, high = (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high")
    return found.union(placed.select(F.col("in_anchor").alias("anchor"), F.col("in_content").alias("content"), low, high))


def repeated_passages(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, split: int = SPLIT, shard_words: int = 1 << 20) -> DataFrame:
    """rows(row, tie, text) -> row, tie, low, high: runs of words covered by windows that occur elsewhere too.

    1. Windows of each text are cut into fragments by their anchors; those whose anchor occurs
       once in the corpus cannot repeat and go.
    2. Fragments of equal anchor and content, by 64 bits of hash each, are combined before any
       words are moved: the words of one of them go to the anchor's shard, with a mark if there
       are several, and are indexed twice then.
    3. The shard's compressed FM-index gives matching statistics of the fragments streamed through
       it, and windows that match over their whole length repeat.
    4. An anchor with more than `split` contents fills no shard: its fragments are cut once more, by
       anchors of another hash, combined, and go to the shards of these; and so on.  What still shares
       one after LEVELS cuts is cut into single windows, which are dealt by all of their words.
    5. The runs found for a content hold for all fragments with it.
    """
    cut = rows.select("row", "tie", "text").mapInArrow(_cut(window, anchor), FRAGMENT)
    shared = staged(cut.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "passages-anchors")
    found = staged(cut.join(shared, "anchor"), "passages-fragments")
    discard(shared)
    one = F.struct("row", "tie", "start", "windows")
    contents = staged(found.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("one")), "passages-contents")
    wanted = _wanted(contents, split).groupBy("row", "tie").agg(F.collect_list("f").alias("wanted"))
    texts = rows.join(wanted, ["row", "tie"]).select("row", "tie", "text", "wanted")
    words = staged(texts.mapInArrow(_fetch(window, "text"), WORDS), "passages-words")
    discard(contents)
    verdicts = staged(_verdicts(words, window, anchor, split, shard_words, 1), "passages-verdicts")
    discard(words)
    # Two fresh reads: Spark can split a content with a third of all fragments.
    placed = found.join(verdicts, ["anchor", "content"])
    return placed.select("row", "tie", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans) -> id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    for batch in slices(batches, "text"):
        data, at = utf8(batch.column(1))
        starts, ends, first = word_bounds(data, at)
        spans = batch.column(2)
        flat = spans.flatten()
        row = np.repeat(np.arange(batch.num_rows), spans.value_lengths().fill_null(0).to_numpy())
        edge = np.zeros(len(starts) + 1, np.int64)
        if len(row):
            np.add.at(edge, first[row] + flat.field("low").to_numpy(), 1)
            np.add.at(edge, first[row] + flat.field("high").to_numpy(), -1)
        gone = np.cumsum(edge[:-1]) > 0
        raw = data.tobytes()
        kept, removed = [], []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            stay = np.flatnonzero(~gone[a:b]) + a
            kept.append(b" ".join([raw[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist())]).decode())
            removed.append(b - a - len(stay))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(first)), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            ["id", "n_words", "n_removed", "kept"],
        )


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept (the words that stay, joined by one space).

    A word goes if a window of `window` words over it has a sequence that also begins anywhere
    else, in the same text or another; all windows are judged on the input.  Null texts have no
    words; texts shorter than a window keep all.  Copies of a text lose all that a window covers,
    each of them.  Rows that repeat an id are rows of their own.  Ids may be of any type.  Words are
    told apart by 64 bits of hash, fragments by 128.
    """
    kind = dict(docs.dtypes)[id_col]
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    row = F.coalesce(F.col(id_col).cast("long"), F.lit(0)) if whole else F.xxhash64(id_col)
    text = text_or_empty(text_col)
    rows = docs.select(row.alias("row"), F.xxhash64(F.col(id_col).isNull(), text).alias("tie"), F.col(id_col).alias("id"), text.alias("text"))
    spans = repeated_passages(rows, window, **options)
    by_row = spans.groupBy("row", "tie").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    none = F.array().cast("array<struct<low:int,high:int>>")
    wide = rows.join(by_row, ["row", "tie"], "left").select("id", "text", F.coalesce("spans", none).alias("spans"))
    out = wide.mapInArrow(_keep, f"id {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)
