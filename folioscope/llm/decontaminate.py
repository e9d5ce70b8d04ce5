"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import discard, mixed, slices, staged, text_or_empty, utf8, with_carried, word_bounds, word_hashes

_KEEP = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _KEEP[_b] = _b
_END = np.uint64(0xD6E8FEB86659FD93)  # stands for what follows a window
SAMPLED = 2  # positions of the embedding in one key
PER_WALK = 16  # keys taken from one random walk
MOST_WALKS = 32
TRIALS = 300  # edited parts for each length on which recall is measured


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, end to end, and where each text begins: a word is a run of
    letters and digits, in lower case."""
    data, at = utf8(pc.utf8_lower(texts))
    data = _KEEP[data]
    starts, ends, first = word_bounds(data, at)
    return word_hashes(data, starts, ends), first


def edits_allowed(n: int, similarity: float) -> int:
    return int((1.0 - similarity) * n + 1e-9)


def grams(words: np.ndarray, q: int) -> np.ndarray:
    """A hash of every q words in a row."""
    out = np.zeros(max(0, len(words) - q + 1), np.uint64)
    for k in range(q):
        out = mixed(out + words[k : k + len(out)])
    return out


def sampled_length(n: int) -> int:
    """Keys sample the first so many of the 3n symbols of an embedding.  A walk over n words runs off
    their end after 2n steps on average; symbols from about there on are the padding, equal for all."""
    return max(1, int(2 * n - np.sqrt(n)))


def embed(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int, walk: int) -> np.ndarray:
    """CGK: row i is the beginning of the embedding of words[starts[i]:ends[i]], padded, `steps` symbols.

    A pointer walks over the window; at each step the symbol under it is written, and a random bit
    of step and symbol says whether it moves on.  Windows at a small edit distance meet again after
    each edit, so few symbols differ.
    """
    out = np.empty((steps, len(starts)), np.uint64)
    at = starts.copy()
    padded = np.append(words, _END)
    for step in range(steps):
        symbol = np.where(at < ends, padded[np.minimum(at, len(words))], _END)
        out[step] = symbol
        at += (mixed(symbol + np.uint64(walk * 1_000_003 + step * 7919 + 1)) >> np.uint64(63)).astype(np.int64)
    return out


@functools.cache
def sampled(n: int, walk: int) -> np.ndarray:
    """The positions that the keys of a walk over n words sample, SAMPLED for each of PER_WALK keys."""
    return np.random.default_rng([n, walk]).integers(0, sampled_length(n), (PER_WALK, SAMPLED))


def keys(embedded: np.ndarray, n: int, walk: int) -> np.ndarray:
    """PER_WALK hash keys of each embedding (one column each of `embedded`)."""
    mark = np.arange(1, PER_WALK + 1, dtype=np.uint64)[:, None] + np.uint64(walk * PER_WALK)
    for k in range(SAMPLED):
        mark = mixed(mark + embedded[sampled(n, walk)[:, k]])
    return mark.T


@functools.cache
def walks_for(n: int, similarity: float, target: float) -> tuple[int, float]:
    """How many walks find `target` of the parts of n words with as many edits as the similarity allows,
    and what share they found; measured on generated texts.  An error if MOST_WALKS do not."""
    rng = np.random.default_rng([17, n])
    rows = []
    for _ in range(TRIALS):
        # Words as often as in texts: some come again and again.
        text = [np.uint64(x) for x in rng.zipf(1.3, 3 * n) + (rng.random(3 * n) < 0.5) * rng.integers(1 << 40, 1 << 62, 3 * n)]
        item = text[:n]
        for _ in range(edits_allowed(n, similarity)):
            at, kind = int(rng.integers(n)), rng.integers(3)
            text[at : at + (kind != 0)] = [] if kind == 1 else [np.uint64(rng.integers(1 << 62))]
        rows += [item, text[:n]]
    words, starts = np.array(rows, np.uint64).ravel(), np.arange(len(rows)) * n
    found = np.zeros(TRIALS, bool)
    for walk in range(MOST_WALKS):
        marks = keys(embed(words, starts, starts + n, sampled_length(n), walk), n, walk)
        found |= (marks[::2] == marks[1::2]).any(axis=1)
        if found.mean() >= target:
            return walk + 1, float(found.mean())
    raise ValueError(f"{MOST_WALKS} walks find {found.mean():.3f} of the parts of {n} words, not {target}")


@dataclass
class Items:
    """The different word sequences of a benchmark, and what finds them."""

    ids: list[list]  # of the rows with each sequence
    words: list[np.ndarray]
    similarity: float
    walks: dict[int, int] = field(default_factory=dict)  # by length
    recall: dict[int, float] = field(default_factory=dict)  # by length, as measured at the limit
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # sorted keys, their items

    @staticmethod
    def of(ids: list, texts: list[str], similarity: float, least: int, target: float) -> Items:
        hashes, first = words_of(pa.array(texts, pa.string()))
        known: dict[bytes, int] = {}
        out = Items([], [], similarity)
        for i, (a, b) in zip(ids, zip(first[:-1], first[1:])):
            if b - a >= max(1, least):
                k = known.setdefault(hashes[a:b].tobytes(), len(out.ids))
                if k == len(out.ids):
                    out.ids.append([])
                    out.words.append(hashes[a:b].copy())
                out.ids[k].append(i)
        for n in sorted({len(w) for w in out.words}):
            out.walks[n], out.recall[n] = walks_for(n, similarity, target)
            which = np.array([k for k, w in enumerate(out.words) if len(w) == n])
            starts = np.arange(len(which)) * n
            words = np.concatenate([out.words[k] for k in which])
            marks = np.concatenate([keys(embed(words, starts, starts + n, sampled_length(n), w), n, w) for w in range(out.walks[n])], axis=1)
            item = np.repeat(which, marks.shape[1])
            order = np.argsort(marks.ravel(), kind="stable")
            out.by_length[n] = marks.ravel()[order], item[order]
        return out


def distance(item: np.ndarray, text: np.ndarray) -> int:
    """The least number of word edits between item and any part of text (Myers' bit vectors)."""
    n = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best = n
    for w in text.tolist():
        eq = masks.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
        best = min(best, score)
    return best


class Finder:
    """Finds the items in slices of documents; one for each task."""

    def __init__(self, items: Items) -> None:
        self.items = items
        self.maps: dict[int, np.ndarray] = {}
        self.bits: dict[int, int] = {}
        self.plans = {n: self._plan(n) for n in items.by_length}
        self.bit_of = {n: np.uint64(k % 64) for k, n in enumerate(items.by_length)}
        for q in {q for _, q, _ in self.plans.values()}:
            used = [w for w in items.words if self.plans[len(w)][1] == q]
            every = [grams(w, q) for w in used]
            marks = np.concatenate([np.full(len(g), np.uint64(1) << self.bit_of[len(w)]) for g, w in zip(every, used)])
            every = np.concatenate(every)
            self.bits[q] = min(22, max(16, (64 * len(every)).bit_length()))
            # For each bucket of grams: the lengths of the items that have one, as bits.
            self.maps[q] = np.zeros(1 << self.bits[q], np.uint64)
            np.bitwise_or.at(self.maps[q], self._bucket(every, q), marks)
        self.bags = [np.unique(w) for w in items.words]

    def _bucket(self, hashes: np.ndarray, q: int) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits[q])).astype(np.int64)

    def _plan(self, n: int) -> tuple[int, int, int]:
        """Edits allowed, the gram length to count, and how many grams a true part shares: each edit
        spoils q grams at most.  Longer grams are rarer; short items need pairs."""
        e = edits_allowed(n, self.items.similarity)
        q = 3 if n - 2 - 3 * e >= 3 else min(n, 2)
        return e, q, max(1, n - q + 1 - q * e)

    def find(self, texts: pa.Array) -> list[list[tuple[int, int]]]:
        """For each text: (item, distance) for each item within its allowed edits."""
        words, first = words_of(texts)
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
        if not len(words) or not self.items.words:
            return out
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        # Where grams of the benchmark stand, and the lengths of the items that have them.
        spots = {}
        for q, table in self.maps.items():
            lengths = table[self._bucket(grams(words, q), q)]
            at = np.flatnonzero(lengths)
            at = at[text[at] == text[at + q - 1]]
            spots[q] = at, lengths[at]
        starts, of = [], []
        for n, (e, q, need) in self.plans.items():
            at, lengths = spots[q]
            at = at[(lengths >> self.bit_of[n] & np.uint64(1)).astype(bool)]
            # `need` grams in a row that a window of n + e words can hold, in one text.
            low, high = at[: max(0, len(at) - need + 1)], at[need - 1 :]
            reach = high - (n + e - q)
            on = (reach <= low) & (text[low] == text[high]) if len(low) else np.zeros(0, bool)
            low, reach = low[on], np.maximum(reach[on], first[text[low[on]]])
            if len(low):
                # The starts reach .. low of all of them; both ascend.
                reach[1:] = np.maximum(reach[1:], low[:-1] + 1)
                many = np.maximum(low - reach + 1, 0)
                begin = np.repeat(reach - (np.cumsum(many) - many), many) + np.arange(many.sum())
                begin = begin[first[text[begin] + 1] - begin >= n - e]
                starts.append(begin)
                of.append(np.full(len(begin), n))
        if not starts:
            return out
        starts, of = np.concatenate(starts), np.concatenate(of)
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for part in np.array_split(np.arange(len(starts)), max(1, -(-len(starts) // 20_000))):
            self._candidates(words, first, text, starts[part], of[part], found)
        for (row, k), near in found.items():
            if (best := self._verify(words, first, row, k, np.unique(np.concatenate(near)))) is not None:
                out[row].append((k, best))
        return out

    def _candidates(self, words, first, text, starts, of, found) -> None:
        """Embed the windows of `of` words at starts, of all lengths side by side, and look up their keys."""
        if not len(starts):
            return
        ends = np.minimum(starts + of, first[text[starts] + 1])
        for walk in range(max(self.items.walks[n] for n in np.unique(of).tolist())):
            embedded = embed(words, starts, ends, sampled_length(int(of.max())), walk)
            for n in np.unique(of).tolist():
                if walk >= self.items.walks[n]:
                    continue
                marks, item = self.items.by_length[n]
                part = np.flatnonzero(of == n)
                own = keys(embedded[:, part], n, walk)
                low = np.searchsorted(marks, own, "left")
                hit = marks[np.minimum(low, len(marks) - 1)] == own
                window, key = np.nonzero(hit)
                if not len(window):
                    continue
                many = np.searchsorted(marks, own[hit], "right") - low[hit]
                which = np.repeat(window, many)
                offset = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                pair = np.unique(which.astype(np.int64) * len(self.items.words) + item[np.repeat(low[hit], many) + offset])
                start, k = starts[part][pair // len(self.items.words)], pair % len(self.items.words)
                group = text[start].astype(np.int64) * len(self.items.words) + k
                order = np.argsort(group, kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                    found.setdefault((int(text[start[rows[0]]]), int(k[rows[0]])), []).append(start[rows])

    def _verify(self, words, first, row: int, k: int, starts: np.ndarray) -> int | None:
        """The least distance of item k near any of the windows, if it is allowed."""
        item, bag = self.items.words[k], self.bags[k]
        n = len(item)
        e = edits_allowed(n, self.items.similarity)
        best = None
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1):
            a, b = max(first[row], run[0] - e - 1), min(first[row + 1], run[-1] + n + e + 1)
            near = words[a:b]
            place = np.minimum(np.searchsorted(bag, near), len(bag) - 1)
            if (bag[place] == near).sum() >= n - e and (d := distance(item, near)) <= e:
                best = d if best is None else min(best, d)
        return best


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = 0.8,
    least_words: int = 1,
    target_recall: float = 0.97,
    block_bytes: int = 32 << 20,
    carry: dict[str, str] | None = None,
) -> DataFrame:
    """One row per input row: id, contaminated, n_items, item_ids, least_distance, and columns of
    docs named in `carry`, as it renames them.

    A text is contaminated by an item of n words if some part of it is within (1 - similarity) * n
    word edits of the item; words are runs of letters and digits, in lower case.  `least_words`
    leaves out items too short to mean anything.  Every window, at each word of every whole text,
    that shares as many grams with the benchmark as such a part must share is embedded and looked
    up by LSH; each candidate is verified exactly.  For each item length there are as many walks as
    find the target recall of parts at the very limit (nearer ones are found more surely, and
    unedited ones always), measured beforehand; too many walks for that are an error.  item_ids are
    sorted; items with equal words are all named; item ids may be of any type with an order.  Null
    texts and items have no words.  Repeated rows get equal results.

    benchmark(item_id, text) is broadcast in blocks of `block_bytes` of text: a larger one takes
    more passes over the documents, with the rows staged between them.
    """
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    part = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    matches = f"array<struct<item:{dict(items.dtypes)['item_id']},distance:int>>"
    carried = [F.col(old).alias(new) for old, new in (carry or {}).items()]
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), F.array().cast(matches).alias("matches"), *carried)
    fields = with_carried(f"id {dict(docs.dtypes)[id_col]}, text string, matches {matches}", docs, carry)
    spark = docs.sparkSession
    for block in range(blocks):
        got = items.where(part == block).orderBy("item_id", "text").toArrow()
        model = Items.of(got.column(0).to_pylist(), got.column(1).to_pylist(), similarity, least_words, target_recall)
        shared, last = spark.sparkContext.broadcast(model), block == blocks - 1
        before, rows = rows, rows.mapInArrow(_pass(shared, to_arrow_type(fields["matches"].dataType), keep_text=not last), fields)
        if not last:
            rows = staged(rows, "leaks-rows")
            shared.unpersist()
            if block:
                discard(before)
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    return rows.select(
        F.col("id").alias(id_col),
        (F.size("matches") > 0).alias("contaminated"),
        F.size(ids).cast("long").alias("n_items"),
        ids.alias("item_ids"),
        F.array_min(F.transform("matches", lambda m: m["distance"])).alias("least_distance"),
        *(carry or {}).values(),
    )


def _pass(model, kind: pa.DataType, keep_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model.value)
        for batch in slices(batches, "text"):
            found = finder.find(batch.column(1))
            earlier = batch.column(2).to_pylist()
            all_of = [
                [*old, *({"item": i, "distance": d} for k, d in new for i in finder.items.ids[k])] for old, new in zip(earlier, found)
            ]
            text = batch.column(1) if keep_text else pa.nulls(batch.num_rows, pa.string())
            columns = [batch.column(0), text, pa.array(all_of, kind), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return work


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that no item contaminates, all columns, without a shuffle."""
    carry = {name: f"_{k}" for k, name in enumerate(docs.columns)}
    clean = find_leaks(docs, benchmark, id_col, text_col, carry=carry, **options).where("not contaminated")
    return clean.select(*[F.col(new).alias(old) for old, new in carry.items()])
