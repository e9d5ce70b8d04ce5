import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm.toxicity import BITS, features, fit, grades_of_labels, occurrences, score_toxicity, scores, tiers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, grade int, severity double"


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"plain{i}" for i in range(200)]
    bad = ["nastyword", "vileword", "awfulword"]
    texts, grades = [], []
    for i in range(n):
        grade = int(rng.choice([0, 0, 0, 1, 2]))
        text = list(rng.choice(words, rng.integers(20, 200)))
        for _ in range((0, 2, 8)[grade]):
            text.insert(rng.integers(len(text)), rng.choice(bad).upper() + "!")
        texts.append(" ".join(text))
        grades.append(grade)
    return texts, np.array(grades)


def test_features_and_scores():
    texts = pa.array(["Bad bad, BAD good", "", "abcdefgh"])
    row, bucket = features(*occurrences(texts))
    assert len(set(zip(row.tolist(), bucket.tolist()))) == len(row)
    assert (row == 0).sum() == 4 + 0 and (row == 1).sum() == 0 and (row == 2).sum() == 3
    weight = np.random.default_rng(0).random(1 << BITS).astype(np.float32)
    want = np.bincount(row, weight[bucket], 3)
    assert scores(texts, weight) == pytest.approx(want)


def test_held_out_grades():
    texts, grade = corpus(900)
    row, bucket = features(*occurrences(pa.array(texts[:600])))
    model = fit(row, bucket, grade[:600])
    assert (model.weight >= 0).all() and (np.diff(model.cuts) > 0).all()
    above = model.at_least(scores(pa.array(texts[600:]), model.weight))
    assert ((above[:, 0] >= 0.5) == (grade[600:] > 0)).mean() > 0.97
    assert np.abs(above.sum(axis=1) - grade[600:]).mean() < 0.25
    two = tiers(row, bucket, np.minimum(grade[:600], 1))
    assert set(two) == {0, 1, 2} and (two[grade[:600] == 2] == 2).mean() > 0.9


def test_score_toxicity(spark):
    texts, grade = corpus(400, 1)
    rows = [(i, t, None, None, None, 1, 1, 0.5) for i, t in enumerate(texts)]
    rows += [(1000, None, None, None, None, 1, 1, 0.5), (1001, "", None, None, None, 1, 1, 0.5), (None, "nastyword " * 9, None, None, None, 1, 1, 0.5)]
    rows += [(1002, "plain1 " * 50_000 + "nastyword vileword awfulword " * 5, None, None, None, 1, 1, 0.5), rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, 1, int(g > 0)) for i, g in enumerate(grade)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = score_toxicity(docs, grades_of_labels(labels)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].toxic == (grade[i] > 0) for i in range(400)]) > 0.97
    assert by[1002].toxic and by[None].toxic and not by[1000].toxic and by[1000].severity == by[1001].severity
    again = {r.doc_id: r for r in score_toxicity(docs.repartition(5), grades_of_labels(labels)).collect()}
    assert all(again[k].severity == pytest.approx(by[k].severity) for k in by)


def test_accuracy_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = labels.where("doc_id % 3 <> 0")
    rows = score_toxicity(docs, grades_of_labels(train)).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert np.mean([r[3] == bool(r[5]) for r in rows]) > 0.9


def test_no_labels_and_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b", None, None, None, 1, 1, 0.5)], SCHEMA)
    assert [(r.severity, r.grade, r.toxic) for r in score_toxicity(docs, grades_of_labels(labels)).collect()] == [(0.0, 0, False)]
    assert score_toxicity(docs.where("false"), grades_of_labels(labels)).count() == 0
