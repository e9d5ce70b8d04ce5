"""Toxicity: cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, slices, staged, text_or_empty, utf8, word_bounds, word_hashes

BITS = 20
#: Features are whole words and their beginnings of so many bytes; each may weigh more the second and third time.
BEGINNINGS = (4, 6)
TIMES = 3
_KEEP = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _KEEP[_b] = _b


def _bucket(hashes: np.ndarray, salt: int) -> np.ndarray:
    return (mixed(hashes + np.uint64(salt)) >> np.uint64(64 - BITS)).astype(np.int64)


def occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) for each word of each text and each of its beginnings: words are runs of
    letters and digits, in lower case."""
    data, at = utf8(pc.utf8_lower(texts))
    data = _KEEP[data]
    starts, ends, first = word_bounds(data, at)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rows, buckets = [row], [_bucket(word_hashes(data, starts, ends), 0)]
    for n in BEGINNINGS:
        long = ends - starts > n
        rows.append(row[long])
        buckets.append(_bucket(word_hashes(data, starts[long], starts[long] + n), n))
    return np.concatenate(rows), np.concatenate(buckets)


def again(bucket: np.ndarray, time: int) -> np.ndarray:
    """The bucket that tells that a feature occurs `time` times or more."""
    return bucket if time == 1 else _bucket(bucket.astype(np.uint64), 1000 + time)


def features(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences -> the different (row, bucket), with a bucket for each of the first TIMES times."""
    key, times = np.unique(row << BITS | bucket, return_counts=True)
    row, bucket = key >> BITS, key & ((1 << BITS) - 1)
    parts = [(row[times >= t] << BITS | again(bucket[times >= t], t)) for t in range(1, TIMES + 1)]
    key = np.unique(np.concatenate(parts))
    return key >> BITS, key & ((1 << BITS) - 1)


def scores(texts: pa.Array, weight: np.ndarray) -> np.ndarray:
    """The sum of the weights of each text's features.  Only features with a weight are counted."""
    row, bucket = occurrences(texts)
    every = np.arange(1 << BITS)
    use = weight != 0
    for t in range(2, TIMES + 1):
        use |= weight[again(every, t)] != 0
    row, bucket = features(row[use[bucket]], bucket[use[bucket]])
    return np.bincount(row, weight[bucket], len(texts))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class Model:
    """One weight for each bucket, shared by all thresholds; thresholds between grades, ascending."""

    weight: np.ndarray
    cuts: np.ndarray

    def at_least(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K-1, one column each."""
        return _sigmoid(z[:, None] - self.cuts[None, :])


def fit(row: np.ndarray, bucket: np.ndarray, grade: np.ndarray, least: int = 3, shrink: float = 1.0e-3) -> Model:
    """Fit twice: with `shrink` times the sizes of the weights added to the mean log loss, which
    leaves a few features; then these alone, with a hundredth of that, so that they get their full weight.

    Features of fewer than `least` rows are left out.
    """
    none = Model(np.zeros(1 << BITS, np.float32), np.zeros(0))
    grades = int(grade.max()) + 1 if len(grade) else 1
    if grades < 2:
        return none
    seen = np.bincount(bucket, minlength=1 << BITS)
    model = _descend(row, bucket, grade, grades, np.flatnonzero(seen >= least), shrink)
    return _descend(row, bucket, grade, grades, np.flatnonzero(model.weight), shrink / 100, 2000)


def tiers(row: np.ndarray, bucket: np.ndarray, grade: np.ndarray, times: float = 8.0, least: int = 3) -> np.ndarray:
    """Grades 0 and 1 -> 0, 1, 2, by how many marked features toxic rows have.

    Labels that know toxic and not toxic only say nothing of severity.  A feature is marked if at
    least `least` rows have it and it is `times` as frequent among the rows graded 1 as among the
    others (a second and third occurrence are features of their own); rows graded 1 with more of
    them than the median get 2.  This is counted before any model is fitted, so the second threshold
    is no echo of the model's own score.
    """
    if set(np.unique(grade)) != {0, 1}:
        return grade
    toxic = grade == 1
    seen = np.bincount(bucket, minlength=1 << BITS)
    among = np.bincount(bucket[toxic[row]], minlength=1 << BITS)
    odds = (among + 0.5) / (toxic.sum() + 1) * (len(grade) - toxic.sum() + 1) / (seen - among + 0.5)
    marked = (seen >= least) & (odds >= times)
    held = np.bincount(row, marked[bucket], len(grade))
    return grade + (toxic & (held > np.median(held[toxic])))


def _descend(row, bucket, grade, grades: int, on: np.ndarray, shrink: float, steps: int = 300) -> Model:
    """Proximal gradient with momentum over the features `on`.  No weight is below zero: harmless
    words around a toxic one do not excuse it, however many.

    A feature's value is its inverse document frequency over the largest one, so that words of
    every text count little.
    """
    n = len(grade)
    place = np.full(1 << BITS, -1)
    place[on] = np.arange(len(on))
    use = place[bucket] >= 0
    row, column = row[use], place[bucket[use]]
    value = np.log((1 + n) / np.maximum(np.bincount(column, minlength=len(on)), 1)) / np.log(1 + n)
    times = lambda w: np.bincount(row, (w * value)[column], n)
    back = lambda g: np.bincount(column, g[row], len(on)) * value
    probe = np.ones(len(on))
    for _ in range(12):
        probe = back(times(probe / max(np.linalg.norm(probe), 1e-12)))
    step = 1.0 / (0.25 * np.linalg.norm(probe) / n + 0.25)
    share = np.array([max((grade >= k).mean(), 0.5 / n) for k in range(1, grades)])
    cuts = np.log((1 - share + 1e-9) / share)
    w = ahead = np.zeros(len(on))
    ahead_cuts, momentum = cuts, 1.0
    for _ in range(steps):
        z = times(ahead)
        edges = np.concatenate([[-np.inf], ahead_cuts, [np.inf]])
        high, low = _sigmoid(edges[grade + 1] - z), _sigmoid(edges[grade] - z)
        p = np.maximum(high - low, 1e-9)
        to_cuts = np.bincount(grade, -high * (1 - high) / p, grades)[: grades - 1] + np.bincount(grade, low * (1 - low) / p, grades)[1:]
        new = ahead - step * back(1.0 - high - low) / n
        new = np.maximum(new - step * shrink, 0.0)
        new_cuts = np.maximum.accumulate(ahead_cuts - step * to_cuts / n + 1e-6 * np.arange(grades - 1))
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / later
        ahead, ahead_cuts = new + pull * (new - w), np.maximum.accumulate(new_cuts + pull * (new_cuts - cuts))
        w, cuts, momentum = new, new_cuts, later
    weight = np.zeros(1 << BITS, np.float32)
    weight[on] = w * value
    return Model(weight, cuts)


def learn(docs: DataFrame, grades: DataFrame, id_col: str, text_col: str, train_rows: int, train_features: int = 16_000_000) -> Model:
    """Fit on about `train_rows` graded rows and `train_features` features of rows at most: the rows with
    the smallest hash of the id.

    grades(id, grade); only rows of documents with text count.  The sampled grades are within that
    bound, so they are broadcast; the features of the sample, within the other bound, come to the
    driver in order of the hash.  A row that alone has more features than are left is passed over.
    """
    grades = grades.where("id is not null and grade is not null")
    rows = grades.count()
    # A little under the bound: the share is of hash values, not of rows.
    most = int(0.97 * train_rows)
    chosen = grades.withColumn("h", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 30)))
    if rows > most:
        chosen = chosen.where(F.col("h") < int(most / rows * (1 << 30)))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").select("h", F.col("grade").cast("int"), "text", F.xxhash64("text").alias("tie"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, bucket = features(*occurrences(batch.column(2)))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(cut), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), words], ["h", "grade", "tie", "words"])

    found = staged(sample.mapInArrow(work, "h long, grade int, tie long, words array<int>"), "toxicity-sample")
    room, fits = train_features, []
    for r in found.select("h", "tie", F.size("words").alias("n")).orderBy("h", "tie").limit(2 * train_rows).collect():
        if r.n <= room:
            room -= r.n
            fits.append((r.h, r.tie))
    fit_rows = docs.sparkSession.createDataFrame(fits, "h long, tie long").distinct()
    table = found.join(F.broadcast(fit_rows), ["h", "tie"], "left_semi").orderBy("h", "tie", "grade").select("grade", "words").toArrow()
    words = table.column("words").combine_chunks()
    sizes = words.value_lengths().to_numpy() if len(words) else np.zeros(0, int)
    bucket = words.flatten().to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
    row, grade = np.repeat(np.arange(len(table)), sizes), table.column("grade").to_numpy().astype(np.int64)
    return fit(row, bucket, tiers(row, bucket, grade))


def score_toxicity(
    docs: DataFrame,
    grades: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    train_rows: int = 6_000,
    train_features: int = 16_000_000,
) -> DataFrame:
    """One row per input row: id, severity (the expected grade), grade (the likeliest), toxic (P(grade >= 1) >= 0.5).

    grades(id, grade) holds ordered grades 0, 1, ..., one an id; of grades that are 0 and 1 only, tiers()
    makes three.  The fit is on a bounded sample, see learn().  Whole texts count.  Null, empty and wordless
    texts get what the thresholds say of no word at all.  Without grades above 0 every severity is
    0.  Repeated rows get equal results.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, grades, id_col, text_col, train_rows, train_features))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in slices(batches, "text"):
            z = scores(batch.column(1), fitted.weight)
            above = fitted.at_least(z)
            edge = np.concatenate([np.ones((len(z), 1)), above, np.zeros((len(z), 1))], axis=1)
            grade = (edge[:, :-1] - edge[:, 1:]).argmax(axis=1).astype(np.int32)
            toxic = above[:, 0] >= 0.5 if above.shape[1] else np.zeros(len(z), bool)
            columns = [batch.column(0), pa.array(above.sum(axis=1)), pa.array(grade), pa.array(toxic)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "severity", "grade", "toxic"])

    return rows.mapInArrow(work, f"{id_col} {dict(docs.dtypes)[id_col]}, severity double, grade int, toxic boolean")


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """labels(doc_id, toxic) -> (id, grade), one row an id: 1 if any of its labels says toxic."""
    return labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("grade")).groupBy("id").agg(F.max("grade").alias("grade"))
