"""Language ID: script ranges, word scores and Viterbi with a switching penalty."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, slices, text_or_empty, utf8, with_carried, word_bounds, word_hashes

# Where each script's letters begin in Unicode; -1 marks what has no letters of interest.
SCRIPTS = ["latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "georgian", "ethiopic", "kana", "han", "hangul"]
SCRIPT_FROM = [
    (0x0041, 0), (0x005B, -1), (0x0061, 0), (0x007B, -1), (0x00AA, 0), (0x00AB, -1), (0x00B5, 0), (0x00B6, -1),
    (0x00BA, 0), (0x00BB, -1), (0x00C0, 0), (0x00D7, -1), (0x00D8, 0), (0x00F7, -1), (0x00F8, 0), (0x02B0, -1),
    (0x0370, 1), (0x0400, 2), (0x0530, 3), (0x0590, 4), (0x0600, 5), (0x0780, -1), (0x0900, 6), (0x0E00, 7),
    (0x0E80, -1), (0x10A0, 8), (0x1100, 12), (0x1200, 9), (0x1400, -1), (0x1E00, 0), (0x1F00, 1), (0x2000, -1),
    (0x2C60, 0), (0x2C80, -1), (0x3040, 10), (0x3100, -1), (0x3400, 11), (0x4DC0, -1), (0x4E00, 11), (0xA000, -1),
    (0xAC00, 12), (0xD7B0, -1), (0xF900, 11), (0xFB00, -1), (0x20000, 11), (0x32000, -1),
]
_FROM = np.array([a for a, _ in SCRIPT_FROM])
_SCRIPT = np.array([b for _, b in SCRIPT_FROM], np.int8)
_ASCII = np.full(256, -1, np.int8)
_ASCII[[*range(65, 91), *range(97, 123)]] = 0

BITS = 16  # buckets for byte trigrams, and as many for whole words


@dataclass
class Words:
    """The words of a slice of texts: bounds, letters by script, and hashed features by byte."""

    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    grams: np.ndarray
    words: np.ndarray


def _letter_scripts(data: np.ndarray) -> np.ndarray:
    """The script of the letter that begins at each byte, or -1."""
    out = _ASCII[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        a, b, c, d = (padded[lead + k] for k in range(4))
        two = (a & 31) << 6 | b & 63
        three = (a & 15) << 12 | (b & 63) << 6 | c & 63
        four = (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63
        point = np.where(a < 0xE0, two, np.where(a < 0xF0, three, four))
        out[lead] = _SCRIPT[np.searchsorted(_FROM, point, "right") - 1]
    return out


def words_of(texts: pa.Array) -> Words:
    data, at = utf8(pc.utf8_lower(texts))
    starts, ends, first = word_bounds(data, at)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(first, starts, ends, none, none.astype(np.int8), none, none)
    scripts = _letter_scripts(data)
    counts = np.zeros(len(data) + 1, np.int64)
    np.cumsum(scripts >= 0, out=counts[1:])
    letters = counts[ends] - counts[starts]
    script = np.maximum.reduceat(scripts, starts)  # Latin, the lowest, gives way to any other
    edge = np.full(len(data) + 2, 32, np.uint8)
    edge[1:-1] = data
    left, right = edge[:-2].copy(), edge[2:].copy()
    left[starts] = 32
    right[ends - 1] = 32
    key = left.astype(np.uint64) | data.astype(np.uint64) << np.uint64(8) | right.astype(np.uint64) << np.uint64(16)
    grams = (mixed(key) >> np.uint64(64 - BITS)).astype(np.int64)
    words = (word_hashes(data, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS)
    return Words(first, starts, ends, letters, script, grams, words)


def _inside(w: Words) -> np.ndarray:
    """The byte positions of words with a letter, in order."""
    lettered = w.letters > 0
    steps = np.zeros(len(w.grams) + 1, np.int8)
    steps[w.starts[lettered]] += 1
    steps[w.ends[lettered]] -= 1
    return np.cumsum(steps[:-1], dtype=np.int8) > 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a task's texts; buckets past the features count letters by script."""
    counts: dict[str, np.ndarray] = {}
    size = 2 << BITS
    for batch in slices(batches, "text"):
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in dict.fromkeys(langs):
            w = words_of(batch.column(1).filter(pa.array(langs == lang)))
            have = counts.setdefault(lang, np.zeros(size + len(SCRIPTS), np.int64))
            have[: 1 << BITS] += np.bincount(w.grams[_inside(w)], minlength=1 << BITS)
            lettered = w.letters > 0
            have[:size] += np.bincount(w.words[lettered], minlength=size)
            have[size:] += np.bincount(w.script[lettered], w.letters[lettered], len(SCRIPTS)).astype(np.int64)
    for lang, have in counts.items():
        on = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(on)), pa.array(on.astype(np.int32)), pa.array(have[on])], ["lang", "bucket", "n"]
        )


@dataclass
class Model:
    """langs; score[bucket, lang], natural logs; able[script, lang]: the candidates of a script."""

    langs: list[str]
    score: np.ndarray
    able: np.ndarray


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train_rows: int, share: float = 0.05) -> Model:
    """Naive Bayes over byte trigrams and words of about `train_rows` labelled rows at most.

    The rows are those with the smallest hash of the id, whatever the number of executors.  What
    comes to the driver is bounded by languages times buckets.  A script's candidates are the
    languages with at least `share` of their letters in it.
    """
    labelled = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.where(~held_out(id_col))
    rows = labelled.count()
    if rows > train_rows:
        labelled = labelled.where(F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(1 << 30)) < int(train_rows / rows * (1 << 30)))
    sample = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    table = sample.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()), key=str.encode)
    size = 2 << BITS
    counts = np.zeros((size + len(SCRIPTS), len(langs)))
    column = pc.index_in(table.column("lang"), pa.array(langs, pa.string())).to_numpy() if langs else np.zeros(0, int)
    counts[table.column("bucket").to_numpy(), column] = table.column("n").to_numpy()
    score = np.zeros((size, len(langs)), np.float32)
    for part in (slice(0, 1 << BITS), slice(1 << BITS, size)):
        have = counts[part]
        smooth = have + 0.5
        score[part] = np.log(smooth / smooth.sum(axis=0))
    letters = counts[size:]
    able = letters >= share * np.maximum(letters.sum(axis=0), 1)
    # Only differences between languages count.
    return Model(langs, score - score.max(axis=1, keepdims=True) if langs else score, able)


def word_scores(w: Words, model: Model, most: float = 8.0) -> np.ndarray:
    """How each language suits each word, 0 for the best and -`most` at least: one word alone never
    decides.  Words without a letter suit all."""
    out = np.zeros((len(w.starts), len(model.langs)), np.float32)
    lettered = np.flatnonzero(w.letters)
    if not len(lettered):
        return out
    inside = _inside(w)
    at = np.cumsum(inside) - 1
    for k in range(len(model.langs)):
        by_byte = model.score[:, k][w.grams[inside]]
        out[lettered, k] = np.add.reduceat(by_byte, at[w.starts[lettered]]) + model.score[:, k][w.words[lettered]]
    able = model.able[w.script[lettered]]
    able |= ~able.any(axis=1, keepdims=True)  # a script that no language uses tells nothing
    part = np.where(able, out[lettered], -np.inf)
    part -= part.max(axis=1, keepdims=True)
    out[lettered] = np.maximum(part, -most)
    return out


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word on the best path of each text; a change costs `penalty`.

    Texts go step by step, side by side.  Before, texts are set apart whose best single language
    cannot be beaten: no run of words gains more than half a penalty by any other language.
    """
    sizes = np.diff(first)
    langs = score.shape[1]
    out = np.zeros(len(score), np.int16)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    text = np.repeat(np.arange(len(full)), sizes[full])
    best = np.add.reduceat(score.astype(np.float64), first[full], axis=0).argmax(axis=1)
    out[:] = best[text]
    hard = np.zeros(len(full), bool)
    for k in range(langs):
        gain = np.cumsum(score[:, k].astype(np.float64) - score[np.arange(len(score)), out])
        apart = text * (2 * np.abs(gain).max() + 1.0)
        before = np.concatenate([[0.0], gain[:-1]]) - apart
        rise = gain - apart - np.minimum.accumulate(before)
        hard |= np.maximum.reduceat(rise, first[full]) > penalty / 2
    todo = full[hard]
    if not len(todo):
        return out
    todo = todo[np.argsort(-sizes[todo], kind="stable")]
    longest = sizes[todo]
    came = np.zeros((len(score), langs), np.int16)
    best_so_far = score[first[todo]].astype(np.float64)
    live = np.searchsorted(-longest, -np.arange(1, longest[0] + 1), "right")
    every = np.arange(langs, dtype=np.int16)
    for t in range(1, int(longest[0])):
        n = live[t]
        now = best_so_far[:n]
        top = now.argmax(axis=1).astype(np.int16)
        jump = now.max(axis=1) - penalty
        at = first[todo[:n]] + t
        stay = now >= jump[:, None]
        came[at] = np.where(stay, every, top[:, None])
        best_so_far[:n] = np.where(stay, now, jump[:, None]) + score[at]
    end = best_so_far.argmax(axis=1).astype(np.int16)
    for t in range(int(longest[0]) - 1, -1, -1):
        n = live[t]
        at = first[todo[:n]] + t
        out[at] = end[:n]
        if t:
            end[:n] = came[at, end[:n]]
    return out


def identify_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    train_rows: int = 20_000,
    penalty: float = 24.0,
    carry: dict[str, str] | None = None,
    known: str | None = None,
) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score, spans, and columns of docs named in
    `carry`, as it renames them.

    Learns from rows that are not held out, with text and language.  spans are runs of words
    (first, upto, lang), whole texts; lang_pred has most letters, score is its share of them; ties
    go to the language that sorts first.  Null texts and texts without a letter are `und` with score
    0 and no spans, and so is every text if nothing could be learned.  A null id is never held out
    and never learned from.  Repeated rows get equal results.  `known` names one more column: the
    share of letters in a script that some learned language uses.
    """
    model = learn(docs, id_col, text_col, lang_col, train_rows)
    rows = docs.select(
        F.col(id_col).alias("id"),
        held_out(id_col).alias("held_out"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
        text_or_empty(text_col).alias("text"),
        *[F.col(old).alias(new) for old, new in (carry or {}).items()],
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield _label(batch, shared.value, penalty, known)

    fields = f"{id_col} {dict(docs.dtypes)[id_col]}, held_out boolean, lang_pred string, score double, spans array<struct<first:int,upto:int,lang:string>>"
    fields += f", {known} double" if known else ""
    return rows.mapInArrow(work, with_carried(fields, docs, carry))


def _label(batch: pa.RecordBatch, model: Model, penalty: float, known: str | None = None) -> pa.RecordBatch:
    n = batch.num_rows
    lettered = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
    names = np.array([*model.langs, "und"], object)
    pick, share, explained = np.full(n, len(model.langs)), np.zeros(n), np.zeros(n)
    spans: list[list[dict]] = [[] for _ in range(n)]
    if model.langs:
        w = words_of(batch.column(3))
        path = viterbi(word_scores(w, model), w.first, penalty)
        text = np.repeat(np.arange(n), np.diff(w.first))
        # A letter of no known script counts too, so that a lettered text always has a winner.
        letters = np.bincount(text * len(model.langs) + path, np.maximum(w.letters, 1e-9), n * len(model.langs))
        letters = letters.reshape(n, -1)
        pick = np.where(lettered, letters.argmax(axis=1), pick)
        share = np.where(lettered, letters.max(axis=1) / np.maximum(letters.sum(axis=1), 1e-12), 0.0)
        # Words without a letter have script -1 and count nothing.
        used = np.bincount(text, w.letters * model.able.any(axis=1)[w.script], n)
        explained = used / np.maximum(np.bincount(text, w.letters, n), 1)
        if len(path):
            begins = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (text[1:] != text[:-1])]))
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(path)]):
                if lettered[text[a]]:
                    base = w.first[text[a]]
                    spans[text[a]].append({"first": int(a - base), "upto": int(b - base), "lang": names[path[a]]})
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            batch.column(1),
            pa.array(names[pick].tolist(), pa.string()),
            pa.array(np.clip(share, 0.0, 1.0)),
            pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("upto", pa.int32()), ("lang", pa.string())]))),
            *([pa.array(explained)] if known else []),
            *batch.columns[4:],
        ],
        [batch.schema.field(0).name, "held_out", "lang_pred", "score", "spans", *([known] if known else []), *batch.schema.names[4:]],
    )
