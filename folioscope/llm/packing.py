"""Packing token sequences: sum-of-squares placement of documents into windows of fixed length.

A document is cut into whole windows, which are sequences as they are, and a rest.  Rests are placed
online: a rest goes to the fill level for which the sum of the squared counts of partly filled windows
ends up least (Csirik et al., 2006), found in one array of counts by level.  What is still open at the
end of a task is poured together, cut at window ends, and the last of it at powers of two, where a
sequence needs no padding.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import slices, with_carried

#: Tokens in a full sequence, and windows that a task holds open before it pours them together: with
#: 4 bytes a token at most 64 MB of rests.
WINDOW, MOST_OPEN = 4096, 4096
#: Characters of words whose tokens a worker remembers; beyond, it starts anew.
MOST_CHARS = 10_000_000
#: Punctuation that may follow a word.
STOPS = ".,;:!?"
#: Sequence ids of a task begin at its number times this.
PER_TASK = 1 << 40


class Words:
    """Token ids of texts, each different stretch between blanks tokenised once.

    Right for tokenizers of words with an end mark that split at white space, and between letters and
    punctuation, before they merge, treat each such part by itself, and make letters small.
    """

    def __init__(self, path: str, end: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer, self._end = Tokenizer.from_file(path), end
        vocabulary = self._tokenizer.get_vocab()
        self._closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self._closes[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._ids, self._at = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self._chars = 0

    def _encode(self, parts: list[str]) -> None:
        """Keep the ids of parts: those of letters in one text, which is parted where a token ends a word."""
        letters = [p for p in parts if p.isalpha()]
        ids = np.array(self._tokenizer.encode(" ".join(letters), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self._closes[ids]) + 1
        if len(ends) != len(letters):
            letters, ids, ends = [], ids[:0], ends[:0]
        done = set(letters)
        rest = [p for p in parts if p not in done]
        found = [e.ids for e in self._tokenizer.encode_batch(rest, add_special_tokens=False)]
        self._known.update(zip([*letters, *rest], range(len(self._known), len(self._known) + len(parts)), strict=True))
        self._chars += sum(map(len, parts))
        self._ids = np.concatenate([self._ids, ids, np.array([i for x in found for i in x], np.uint32)])
        sizes = np.concatenate([np.diff(ends, prepend=0), np.array([len(x) for x in found], np.int64)])
        self._at = np.concatenate([self._at, self._at[-1] + np.cumsum(sizes)])

    def _numbers(self, parts: pa.DictionaryArray) -> np.ndarray:
        """The number of each part, under which its ids are."""
        different = parts.dictionary.to_pylist()
        if new := [p for p in different if p not in self._known]:
            self._encode(new)
        known = self._known
        return np.array([known[p] for p in different], np.int64)[parts.indices.to_numpy(zero_copy_only=False)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each closed by the end id, and where each text's begin and end.

        A word has two parts, itself and the punctuation that follows a letter or digit at its end.  Small letters say the same,
        but not in what may be a special token.
        """
        if self._chars > MOST_CHARS:
            self._forget()
        pieces = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = pieces.flatten().dictionary_encode()
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False))]).astype(np.int64)
        core, tail = pc.utf8_rtrim(words.dictionary, STOPS), pc.replace_substring_regex(words.dictionary, f"^(?s:.*)[^{STOPS}]", "")
        parted = pc.match_substring_regex(core, r"[\pL\pN]$")  # else the punctuation belongs to what is before
        core, tail = pc.if_else(parted, core, words.dictionary), pc.if_else(parted, tail, "")
        plain = pc.and_not(pc.string_is_ascii(core), pc.match_substring(core, "<|"))
        core = pc.if_else(plain, pc.ascii_lower(core), core)
        halves = np.column_stack([self._numbers(core.dictionary_encode()), self._numbers(tail.dictionary_encode())])
        part = halves[words.indices.to_numpy(zero_copy_only=False)].ravel()
        size = self._at[part + 1] - self._at[part]
        before = np.concatenate([[0], np.cumsum(size)])
        at = before[2 * starts] + np.arange(len(starts))  # one end id for each text before
        out = np.full(at[-1], self._end, np.uint32)
        keep = np.ones(at[-1], bool)
        keep[at[1:] - 1] = False
        out[keep] = self._ids[np.repeat(self._at[part] - before[:-1], size) + np.arange(before[-1])]
        return out, at


@functools.cache
def _words(path: str, end: int) -> Words:
    """One for all tasks of a worker."""
    return Words(path, end)


class Packer:
    """The windows of one task; each pieces() is what has become of sequences since the last call.

    A piece is (row, start in its document, ids, sequence, offset).
    """

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN, first: int = 0) -> None:
        self._window, self._most, self._next = window, most_open, first
        self._count = np.zeros(window + 1, np.int64)
        self._open: dict[int, list[list]] = {}
        self._n_open = 0
        self._done: list[tuple] = []

    def level(self, size: int) -> int:
        """The fill level, 0 for a new window, to which a rest of this size is added.

        Moving one window from level h to h + size changes the sum of squared counts by
        2 (count[h + size] - count[h] + 1); a window that is full leaves the sum, a new one has no
        level to leave.  Equal changes: the fuller window.
        """
        here, there = self._count[1 : self._window - size + 1], self._count[1 + size : self._window + 1]
        change = 2 * (there - here) + 2
        if len(change):
            change[-1] = 1 - 2 * here[-1]
        change = np.where(here > 0, change, np.iinfo(np.int64).max)
        best = len(change) - 1 - int(np.argmin(change[::-1])) if len(change) else -1
        new = 2 * int(self._count[size]) + 1
        return best + 1 if best >= 0 and change[best] <= new else 0

    def add(self, row: object, ids: np.ndarray) -> None:
        whole = len(ids) // self._window * self._window
        for start in range(0, whole, self._window):
            self._close([(row, start, ids[start : start + self._window])])
        size = len(ids) - whole
        if not size:
            return
        level = self.level(size)
        held = self._open[level].pop() if level else []
        if level:
            self._count[level] -= 1
            self._n_open -= 1
        held.append((row, whole, ids[whole:].copy()))
        level += size
        if level == self._window:
            self._close(held)
            return
        self._open.setdefault(level, []).append(held)
        self._count[level] += 1
        self._n_open += 1
        if self._n_open >= self._most:
            self.pour(last=False)

    def _close(self, held: list[tuple]) -> None:
        offset = 0
        for row, start, ids in held:
            self._done.append((row, start, ids, self._next, offset))
            offset += len(ids)
        self._next += 1

    def pour(self, last: bool = True) -> None:
        """Empty the open windows into full ones, the fullest first; what is left over stays open or,
        at the last, becomes sequences of the powers of two that it is the sum of."""
        queue = [piece for level in sorted(self._open, reverse=True) for held in self._open[level] for piece in held]
        self._open, self._n_open = {}, 0
        self._count[:] = 0
        held, fill = [], 0
        left = sum(len(piece[2]) for piece in queue)
        want = self._want(left, last)
        for row, start, ids in queue:
            while len(ids) and want:
                taken = ids[: want - fill]
                held.append((row, start, taken))
                start, ids, fill = start + len(taken), ids[len(taken) :], fill + len(taken)
                if fill == want:
                    self._close(held)
                    left -= want
                    held, fill, want = [], 0, self._want(left, last)
            if len(ids):
                held.append((row, start, ids))
                fill += len(ids)
        if held:
            self._open[fill] = [held]
            self._count[fill] += 1
            self._n_open = 1

    def _want(self, left: int, last: bool) -> int:
        """How long the next sequence is; 0 if the rest is to stay open."""
        if left >= self._window:
            return self._window
        return 1 << left.bit_length() >> 1 if last else 0

    def pieces(self) -> list[tuple]:
        done, self._done = self._done, []
        return done


def pack_documents(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text: str = "text", end: int = 2, window: int = WINDOW, most_open: int = MOST_OPEN, carry: dict[str, str] | None = None
) -> DataFrame:
    """One row for each piece of a document: doc_id, start (its document's ids before it), length, ids (binary:
    little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (where it stands in the sequence).

    `tokenizer` is the path of a tokenizer file that every executor has; each document's ids end with
    `end`.  The window must be a power of two.  Each task packs the rows of its input partition as
    they come, with no shuffle; a task that is run again packs the same rows alike, and sequence ids
    of tasks do not meet.  At most `most_open` windows are open in a task, whatever its input.

    Null texts are empty: their one id is `end`.  Null and repeated ids are rows of their own, very
    long texts fill many sequences, an empty table gives no rows.  `carry` renames columns of docs
    that come along.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    names = [id_col, text, *(carry or {})]
    asked = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(names)])
    schema = with_carried("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long", docs, carry)
    schema["doc_id"].dataType = docs.schema[id_col].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer, end)
        task = TaskContext.get()
        packer = Packer(window, most_open, (task.partitionId() if task else 0) * PER_TASK)

        def made(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(pieces), 256):
                rows = [
                    (row[0], start, len(ids), ids.astype("<u4").tobytes(), row[1], sequence, offset, *row[2:])
                    for row, start, ids, sequence, offset in pieces[k : k + 256]
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=labels)

        labels, kinds = [f.name for f in schema], [to_arrow_type(f.dataType) for f in schema]
        for part in slices(batches, "c1", 1 << 22):
            ids, at = words(part.column(1))
            others = [c.to_pylist() for k, c in enumerate(part.columns) if k != 1]
            for k in range(part.num_rows):
                own = ids[at[k] : at[k + 1]]
                packer.add((others[0][k], len(own), *(c[k] for c in others[1:])), own)
            yield from made(packer.pieces())
        packer.pour()
        yield from made(packer.pieces())

    return asked.mapInArrow(work, schema)
