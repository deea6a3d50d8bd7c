import math
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetrace.llm import quality as Q
from pagetrace.llm.registry import registered
from tests.llm.fixtures import documents, none, odd_documents

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = registered()["op7_ordinal_quality"][0](spark, FOLDER)
    assert rows.count() == 1000
    own = rows.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").where("held_out").collect()
    good, low = ([r["kept"] for r in own if r["quality"] == k] for k in (1, 0))
    assert np.mean(good) > 0.95 and np.mean(low) < 0.2
    assert all(r["kept"] == (r["tail_probability"] >= Q.KEEP) and 0 <= r["expected_grade"] <= 2 for r in own)


def test_thresholds_are_ordered_and_gradient_is_right():
    random = np.random.default_rng(1)
    grades = random.integers(0, Q.GRADES, 400)
    rows = [(np.array([int(g), 5 + int(random.integers(3))], np.int32), np.array([1.0, 0.5], np.float32)) for g in grades]
    model = Q.train(rows, grades)
    assert (np.diff(model.thresholds) > 0).all()
    scores = np.array([model.weights[b] @ v for b, v in rows])
    expected = model.tails(scores).sum(1)
    means = [expected[grades == g].mean() for g in range(Q.GRADES)]
    assert means[0] < 0.4 and 0.6 < means[1] < 1.4 and means[2] > 1.6
    # The optimum of the likelihood in the first threshold, other parameters held.
    def loss(shift):
        below = np.column_stack([np.zeros(len(grades)), 1 - Q.Ordinal(model.weights, model.thresholds + shift).tails(scores), np.ones(len(grades))])
        at = np.arange(len(grades))
        return -np.log(below[at, grades + 1] - below[at, grades]).mean()

    assert loss(0) <= min(loss(-0.1), loss(0.1)) + 1e-4


def test_score_equals_features():
    model = Q.Ordinal(np.random.default_rng(2).normal(size=Q.BUCKETS), np.array([0.0, 1.0]))
    for text in ("", " \n", "One two TWO 33 four!! é", "a a a a | b | c\n" * 30, "\U0001f600 日本"):
        buckets, values = Q.features(text)
        assert np.isclose(model.score(text), (model.weights[buckets] * values).sum(), atol=1e-4)


def test_grades(spark):
    given = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 1, 0), (4, 1, None), (5, None, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert [r["grade"] for r in Q.graded(given).collect()] == [0, 1, 2, 2, None, 2]


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = Q.fit(docs, Q.graded(labels))
    assert np.allclose(model.weights, Q.fit(docs.repartition(5), Q.graded(labels)).weights)
    scored = Q.scored(odd_documents(spark).withColumn("_tail", F.lit("own")), model)
    assert scored.count() == 10 and scored.columns.count("_tail") == 1
    assert Q.scored(none(spark), model).collect() == []
    for given in (labels.limit(0), labels.where("quality = 1 AND toxic = 0")):
        untaught = Q.scored(documents(spark, ["a", "", None]), Q.fit(docs, Q.graded(given)))
        assert {(round(r["_expected"]), r["_tail"] >= Q.KEEP) for r in untaught.collect()} == {(2, True)}


def test_every_row_equals_a_plain_scorer(spark):
    """Expected grade and tail of all rows from the fitted weights, one feature after the other."""
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = Q.fit(docs, Q.graded(labels))
    got = {r["doc_id"]: r for r in Q.scored(docs, model).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for row in rows:
        words, shapes, figures = Q.counted(row["text"] or "")
        n = max(1, sum(words.values()))
        names = [("w" + w, k / n) for w, k in words.items()] + [("s" + s.decode("ascii", "replace"), k / n) for s, k in shapes.items()]
        names += [("f" + f, Q.FIGURE) for f in figures]
        score = sum(model.weights[crc32(name.encode()) % Q.BUCKETS] * value for name, value in names)
        tails = [1 - 1 / (1 + math.exp(-max(-60, min(60, t - score)))) for t in model.thresholds]
        own = got[row["doc_id"]]
        assert (own["_expected"], own["_tail"]) == pytest.approx((sum(tails), tails[0]), abs=1e-6)
