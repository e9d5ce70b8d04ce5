"""Hard negatives: rows of another label whose scores lie in a window below a positive's.

The score is an inner product.  Each row gets one more component, so that all rows have one norm M; a
query gets zero there.  Then distance² = |q|² + M² - 2 score: the highest score is the nearest row,
and a window of scores is an annulus about the query.  A vantage-point tree fitted on a bounded
sample deals every row to a shard; each task grows one over its shard and walks it nearest first,
inside the annulus, until k rows that count are found and nothing left can beat the last of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Rows that the tree over shards is fitted on, rows of a shard, its most levels (2**10 leaves, larger
#: ones in parts), queries that meet a shard in one task, rows of a bucket in a task's tree.
SAMPLE, SHARD, MOST_LEVELS, QUERIES, BUCKET = 8_192, 8_192, 10, 4_096, 64
#: Sums of integer products below this are exact in doubles.
EXACT = float(1 << 53)


class VantageTree:
    """A complete binary tree: at each node a vantage point and a radius; nearer points go left.

    Node i has children 2i + 1 and 2i + 2; leaves are numbered from the left.
    """

    def __init__(self, points: np.ndarray, levels: int) -> None:
        self.levels = levels
        inner = (1 << levels) - 1
        self.vantage, self.radius = np.zeros((inner, points.shape[1])), np.zeros(inner)
        members = {0: np.arange(len(points))}
        for node in range(inner):
            own = members.pop(node)
            near = far = own
            if len(own):
                spread = _distances(points[own], points[own[0]])
                self.vantage[node] = points[own[np.argmax(spread)]]  # at the rim: its distances differ most
                away = _distances(points[own], self.vantage[node])
                self.radius[node] = np.median(away)
                near, far = own[away <= self.radius[node]], own[away > self.radius[node]]
            members[2 * node + 1], members[2 * node + 2] = near, far

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each point, and its distances from the vantage points on the way."""
        node, away = np.zeros(len(points), np.int64), np.zeros((len(points), self.levels))
        for level in range(self.levels):
            away[:, level] = _distances(points, self.vantage[node])
            node = 2 * node + 1 + (away[:, level] > self.radius[node])
        return node - ((1 << self.levels) - 1), away

    def bounds(self, queries: np.ndarray, leaves: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and leaf the least and greatest distance of any point there, by the triangle
        inequality; low and high (leaf, level) are what route() said of the leaf's points."""
        at_least = np.zeros((len(queries), len(leaves)))
        at_most = np.full(at_least.shape, np.inf)
        square = (queries**2).sum(1)[:, None] + (self.vantage**2).sum(1) - 2 * queries @ self.vantage[:, : queries.shape[1]].T
        away = np.sqrt(np.maximum(square, 0))
        for level in range(self.levels):
            d = away[:, (1 << level) - 1 + (leaves >> (self.levels - level))]
            np.maximum(at_least, np.maximum(d - high[:, level], low[:, level] - d), out=at_least)
            np.minimum(at_most, d + high[:, level], out=at_most)
        return at_least, at_most


def _distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - others) ** 2).sum(-1))


def _matrix(lists: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix; missing components are zero."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(lists), dims))
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _augmented(rows: np.ndarray, square: float) -> np.ndarray:
    return np.column_stack([rows, np.sqrt(np.maximum(square - (rows**2).sum(1), 0))])


def _score_bounds(queries: np.ndarray, square: float, at_least: np.ndarray, at_most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest and lowest score at such distances, with room for rounding."""
    sums = ((queries**2).sum(1) + square)[:, None]
    return (sums - at_least**2) / 2 + 1e-6 * sums, (sums - at_most**2) / 2 - 1e-6 * sums


class Shard:
    """A task's rows under a tree, ready for queries."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, square: float) -> None:
        points = _augmented(rows, square)
        self._tree = VantageTree(points, max(0, int(np.ceil(np.log2(max(len(rows), 1) / BUCKET)))))
        leaf, away = self._tree.route(points)
        order = np.argsort(leaf, kind="stable")
        self._ids, self._labels, self._rows, self._square = ids[order], labels[order], rows[order], square
        self._leaves, self._starts = np.unique(leaf[order], return_index=True)
        self._ends = np.append(self._starts[1:], len(rows))
        self._low, self._high = np.minimum.reduceat(away[order], self._starts), np.maximum.reduceat(away[order], self._starts)

    def search(self, queries: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of the first k rows of the same label, or of another, whose scores are in
        [low, high]: by score from the highest, then by id."""
        most, least = _score_bounds(queries, self._square, *self._tree.bounds(queries, self._leaves, self._low, self._high))
        for q in range(len(queries)):
            met = np.flatnonzero((most[q] >= low[q]) & (least[q] <= high[q]))
            met = met[np.argsort(-most[q, met], kind="stable")]
            ids, scores, floor = np.zeros(0, np.int64), np.zeros(0), low[q]
            at, step = 0, 1
            while at < len(met) and most[q, met[at]] >= floor:
                take, at, step = met[at : at + step], at + step, 2 * step
                rows = np.concatenate([np.arange(self._starts[b], self._ends[b]) for b in take])
                found = self._rows[rows] @ queries[q]
                keep = (found >= floor) & (found <= high[q]) & ((self._labels[rows] == labels[q]) == same)
                if keep.any():
                    ids, scores = np.concatenate([ids, self._ids[rows[keep]]]), np.concatenate([scores, found[keep]])
                    first = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[first], scores[first]
                    if len(ids) == k:
                        floor = max(floor, scores[-1])
            if len(ids):
                yield q, ids, scores


class Index:
    """All rows, dealt to shards by a tree that is fitted on the SAMPLE rows with the least hashes."""

    def __init__(self, rows: DataFrame, n: int, dims: int, square: float) -> None:
        self.dims, self.square = dims, square
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
        points = _augmented(_matrix(sample.column("v"), dims), square)
        self.tree = tree = VantageTree(points, min(MOST_LEVELS, max(0, int(np.ceil(np.log2(max(n, 1) / SHARD))))))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf, away = tree.route(_augmented(_matrix(batch.column(2), dims), square))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32()), pa.array(list(away), pa.list_(pa.float64()))], names=names)

        names = ["id", "label", "v", "leaf", "away"]
        dealt = staged(rows.select("id", "label", "v").mapInArrow(deal, "id long, label string, v array<long>, leaf int, away array<double>"), "vectors")
        ends = [f(F.col("away")[level]).alias(f"{kind}{level}") for kind, f in (("low", F.min), ("high", F.max)) for level in range(tree.levels)]
        leaves = dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *ends).orderBy("leaf").collect()  # 2**MOST_LEVELS at most
        self.leaves = np.array([r.leaf for r in leaves], np.int64)
        self.low, self.high = (np.array([[r[f"{kind}{level}"] for level in range(tree.levels)] for r in leaves]).reshape(len(leaves), tree.levels) for kind in ("low", "high"))
        self.parts = [-(-r.n // SHARD) for r in leaves]
        counts = rows.sparkSession.createDataFrame([(r.leaf, p) for r, p in zip(leaves, self.parts, strict=True)], "leaf int, parts long")
        part = F.pmod(F.xxhash64("id"), F.col("parts"))
        self.rows = dealt.join(F.broadcast(counts), "leaf").select("id", "label", "v", F.concat_ws("-", "leaf", part).alias("shard"))

    def search(self, queries: DataFrame, k: int, *, same: bool) -> DataFrame:
        """queries(q, p, v, label, low, high) -> (q, p, id, score, rank): the first k rows with scores in [low, high].

        Each query first meets the leaf that is nearest its annulus; the k-th score found there narrows
        the annulus for the others, of which only those that still meet it are searched.
        """
        queries = staged(queries, "questions")
        blocks = max(1, -(-queries.count() // QUERIES))
        home = staged(self._met(queries, blocks, k, same, home=True), "near")
        found = Window.partitionBy("q", "p")
        floor = home.groupBy("q", "p").agg(F.count(F.lit(1)).alias("n"), F.collect_list("score").alias("scores"))
        floor = floor.where(F.col("n") >= k).select("q", "p", F.sort_array("scores", asc=False)[k - 1].alias("floor"))
        narrowed = queries.join(floor, ["q", "p"], "left").withColumn("low", F.greatest("low", F.coalesce("floor", "low"))).drop("floor")
        rest = self._met(narrowed, blocks, k, same, home=False)
        ranked = home.unionByName(rest).withColumn("rank", F.row_number().over(found.orderBy(F.desc("score"), "id")))
        return ranked.where(F.col("rank") <= k)

    def _met(self, queries: DataFrame, blocks: int, k: int, same: bool, *, home: bool) -> DataFrame:
        tree, leaves, low, high, parts, square, dims = self.tree, self.leaves, self.low, self.high, self.parts, self.square, self.dims

        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 512):
                    batch = whole.slice(start, 512)
                    vectors = _matrix(batch.column("v"), dims)
                    most, least = _score_bounds(vectors, square, *tree.bounds(vectors, leaves, low, high))
                    lows, highs = (batch.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("low", "high"))
                    meets = (most >= lows) & (least <= highs)
                    first = np.zeros_like(meets)
                    first[np.arange(len(meets)), np.argmax(np.where(meets, np.minimum(most, highs), -np.inf), axis=1)] = True
                    for row, leaf in zip(*np.nonzero(meets & (first if home else ~first)), strict=True):
                        one = batch.slice(row, 1)
                        for part in range(parts[leaf]):
                            yield pa.RecordBatch.from_arrays([*one.columns, pa.array([f"{leaves[leaf]}-{part}"])], names=[*one.schema.names, "shard"])

        return self._answers(queries, plan, blocks, k, same)

    def _answers(self, queries: DataFrame, plan: Callable, blocks: int, k: int, same: bool) -> DataFrame:
        square, dims = self.square, self.dims

        def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
            out: dict[str, list] = {c: [] for c in ("q", "p", "id", "score")}
            if rows.num_rows and asked.num_rows:
                names = np.unique(np.concatenate([t.column("label").to_pylist() for t in (rows, asked)]), return_inverse=True)[1]
                shard = Shard(rows.column("id").to_numpy(), names[: rows.num_rows], _matrix(rows.column("v"), dims), square)
                q, p, low, high = (asked.column(c).to_numpy() for c in ("q", "p", "low", "high"))
                for k_, ids, scores in shard.search(_matrix(asked.column("v"), dims), names[rows.num_rows :], low, high, k, same):
                    for column, values in zip(out.values(), ([q[k_]] * len(ids), [p[k_]] * len(ids), ids, scores), strict=True):
                        column.extend(values)
            return pa.table({c: pa.array(np.array(x, np.int64), pa.int64()) for c, x in out.items()})

        fields = "q long, p long, v array<long>, label string, low double, high double, shard string"
        asked = queries.select("q", "p", "v", "label", "low", "high").mapInArrow(plan, fields)
        asked = asked.withColumn("block", F.pmod(F.xxhash64("q", "p"), F.lit(blocks)).cast("int"))
        rows = self.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        key = ("shard", "block")
        return rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(meet, "q long, p long, id long, score long")


def hard_negatives(
    vectors: DataFrame, anchors: Column, *, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: int = 256, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row for which `anchors`
    holds, and each of its first `positives` other rows of the same label, the first `negatives` rows
    of other labels whose score is from low_percent to high_percent of the positive's.

    A component x counts as floor(scale * x), the score is the integer inner product with the anchor;
    higher scores come first, ties by smaller id.  Every row is indexed and the answer is exact.
    Rows with a null id or label, a null vector, or a component that is null or not finite take no
    part; shorter vectors end in zeros; rows that repeat id, label and vector are one row.  No usable
    rows: no rows.  Vectors whose squared norm, scaled, is 2**53 or more are an error.

    Equal vectors of one label have one score: as many of them are indexed as can be asked for, those
    with the smallest ids, and anchors that are equal are one question.
    """
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"), anchors.alias("anchor"),
        F.when(~bad, F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))).alias("v"),
    )
    rows = staged(whole.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").groupBy("id", "label", "v").agg(F.coalesce(F.bool_or("anchor"), F.lit(False)).alias("anchor")), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims"), F.max(square).alias("square")).first()
    fields = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not size.n:
        return vectors.sparkSession.createDataFrame([], fields)
    if size.square >= EXACT:
        raise ValueError(f"a squared norm of {size.square:.3g} is beyond exact integer scores")
    need = max(negatives, positives + 1)
    nth = F.row_number().over(Window.partitionBy("label", "v").orderBy("id"))
    index = Index(rows.withColumn("nth", nth).where(F.col("nth") <= need), size.n, size.dims, size.square)

    asking = rows.where("anchor")
    classes = staged(asking.groupBy("label", "v").agg(F.min("id").alias("q")), "classes")
    wide = classes.select("q", F.lit(0).cast("long").alias("p"), "v", "label", F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    near = index.search(wide, positives + 1, same=True).select("q", F.col("id").alias("positive_id"), F.col("score").alias("p"))
    own = asking.join(classes, ["label", "v"]).select(F.col("id").alias("anchor_id"), "q").join(near, "q").where("anchor_id <> positive_id")
    first = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("p"), "positive_id"))
    pairs = staged(own.withColumn("first", first).where(F.col("first") <= positives).drop("first"), "positives")

    low, high = F.ceil(F.col("p") * low_percent / 100).cast("double"), F.floor(F.col("p") * high_percent / 100).cast("double")
    asked = pairs.select("q", "p").distinct().join(classes, "q").select("q", "p", "v", "label", low.alias("low"), high.alias("high"))
    found = index.search(asked.where("low <= high"), negatives, same=False)
    return pairs.join(found, ["q", "p"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("p").alias("positive_score"), F.col("score").alias("negative_score")
    )
