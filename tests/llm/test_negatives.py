"""Hard negatives against every score, the tree's bounds, and awkward rows."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import negatives
from folioscope.llm.negatives import Shard, VantageTree, hard_negatives

FIELDS = "vec_id long, embedding array<float>, label int"


def plain(rows, is_anchor, scale=256, positives=5, k=10, low=30, high=90):
    usable = {}
    for i, e, label in rows:
        if i is not None and label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            usable[(i, str(label), tuple(int(np.floor(scale * float(np.float32(x)))) for x in e))] = None
    out = set()

    def score(a, b):
        return sum(x * y for x, y in zip(a[2], b[2]))

    for a in usable:
        if not is_anchor(a[0]):
            continue
        ranked = sorted(((-score(a, b), b[0], b[1]) for b in usable if b[0] != a[0]))
        for minus, positive, _ in [r for r in ranked if r[2] == a[1]][:positives]:
            p = -minus
            near = [r for r in ranked if r[2] != a[1] and low * p <= -100 * r[0] <= high * p]
            out |= {(a[0], positive, rank, n[1], p, -n[0]) for rank, n in enumerate(near[:k], 1)}
    return out


def mined(spark, rows, **options):
    found = [tuple(r) for r in hard_negatives(spark.createDataFrame(rows, FIELDS), F.col("vec_id") % 3 == 0, **options).collect()]
    assert len(found) == len(set(found))
    return set(found)


def spread(n, seed, dims=6, labels=3):
    rng = np.random.default_rng(seed)
    return [(k, [float(x) for x in rng.normal(size=dims).round(1 if seed % 2 else 3)], int(rng.integers(labels))) for k in range(n)]


def test_against_every_score(spark, monkeypatch):
    rows = spread(150, 1)
    want = plain(rows, lambda i: i % 3 == 0)
    assert len(want) > 500 and mined(spark, rows) == want
    for name, value in (("SHARD", 16), ("BUCKET", 2), ("QUERIES", 7), ("SAMPLE", 40)):  # many leaves, parts, blocks
        monkeypatch.setattr(negatives, name, value)
    assert mined(spark, rows) == want
    monkeypatch.setattr(negatives, "MOST_LEVELS", 1)
    assert mined(spark, rows) == want


def test_copies_ties_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD", 16)
    hot = [0.5, -0.25, 1.0, 0.0, 0.125, 0.0]
    rows = spread(60, 3) + [(k, hot, k % 2) for k in range(100, 160)] + [(k, [x / 2 for x in hot], 2) for k in range(200, 230)]
    rows += rows[:20]
    assert mined(spark, rows) == plain(rows, lambda i: i % 3 == 0)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(300, None, 1), (303, [1.0, None], 1), (306, [nan, 1.0], 1), (309, [inf, 1.0], 1), (312, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (315, [1.0], 1), (318, [], 1)]
    rows = spread(30, 2, dims=2, labels=2) + bad
    assert mined(spark, rows) == plain(rows, lambda i: i is not None and i % 3 == 0)
    assert mined(spark, bad[:6]) == set() == mined(spark, [])
    assert mined(spark, [(0, [1.0], 1)]) == set()
    with pytest.raises(ValueError):
        mined(spark, [(0, [3e38], 1), (3, [1.0], 1)])


def test_extra_columns_of_clashing_names(spark):
    rows = spread(40, 5)
    frame = spark.createDataFrame(rows, FIELDS).withColumns({c: F.lit("x") for c in ("id", "v", "q", "p", "rank", "score", "shard", "leaf", "anchor", "low")})
    assert {tuple(r) for r in hard_negatives(frame, F.col("vec_id") % 3 == 0).collect()} == plain(rows, lambda i: i % 3 == 0)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 200), st.integers(0, 5), st.integers(0, 1000))
def test_bounds_hold(n, levels, seed):
    rng = np.random.default_rng(seed)
    points, queries = np.round(rng.normal(size=(n, 4)), rng.integers(3)), rng.normal(size=(7, 3))
    tree = VantageTree(points, levels)
    leaf, away = tree.route(points)
    leaves = np.unique(leaf)
    low, high = (np.array([f(away[leaf == x], axis=0) for x in leaves]).reshape(len(leaves), levels) for f in (np.min, np.max))
    at_least, at_most = tree.bounds(queries, leaves, low, high)
    true = np.sqrt(((np.column_stack([queries, np.zeros(7)])[:, None] - points[None]) ** 2).sum(-1))
    for j, x in enumerate(leaves):
        assert (true[:, leaf == x] >= at_least[:, j, None] - 1e-6).all() and (true[:, leaf == x] <= at_most[:, j, None] + 1e-6).all()


def test_walk_skips_what_cannot_count():
    rng = np.random.default_rng(4)
    rows = np.concatenate([np.round(50 * c + rng.normal(size=(500, 3))) for c in np.eye(3)])
    shard = Shard(np.arange(1500), np.zeros(1500, int), rows, (rows**2).sum(1).max())
    most, least = negatives._score_bounds(rows[:1], shard._square, *shard._tree.bounds(rows[:1], shard._leaves, shard._low, shard._high))
    assert (most < 1200).any() and (least <= most).all()  # whole buckets of the other clusters lie beyond a floor of 1200
    q, ids, scores = next(shard.search(rows[:1], np.zeros(1, int), np.array([1200.0]), np.array([np.inf]), 10, True))
    every = rows @ rows[0]
    first = np.lexsort((np.arange(1500), -every))[:10]
    assert (ids == first).all() and (scores == every[first]).all()


def test_matrix_pads():
    got = negatives._matrix(pa.array([[1, 2], [], [3]], pa.list_(pa.int64())), 3)
    assert got.tolist() == [[1, 2, 0], [0, 0, 0], [3, 0, 0]]
