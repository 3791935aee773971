"""The trained fear scorer by hand and on awkward rows."""

import math

import pytest

from pagerisk.operators import fear
from pagerisk.plans import catalog

catalog.load()


def test_weights_by_hand(spark):
    rows = [("Doom doom today", 1), ("calm today", 0), (None, 1), ("unseen", None), ("", 0)]
    frame = spark.createDataFrame(rows, "text string, label int")
    found = {r.word: r for r in fear.fit_fear_weights(frame, prior_words=10.0).collect()}
    assert set(found) == {"doom", "today", "calm"}
    prior = 2 * 10 / 5
    want = math.log((2 + prior) / (3 + 10 - 2 - prior)) - math.log(prior / (2 + 10 - prior))
    assert found["doom"].weight == pytest.approx(want)
    assert found["doom"].z == pytest.approx(want / math.sqrt(1 / (2 + prior) + 1 / prior))
    assert (found["doom"].n_fear, found["doom"].n_other) == (2, 0)


def test_predictions_on_awkward_rows(spark):
    weights = spark.createDataFrame(
        [("doom", 2.0, 3.0), ("calm", -1.0, -3.0), ("maybe", 9.0, 0.1)],
        "word string, weight double, z double",
    )
    rows = [(1, "Doom, doom and calm", 7), (2, None, 7), (3, "", 7), (4, "calm maybe", 7)]
    frame = spark.createDataFrame(rows, "id long, text string, score long")
    found = {r.id: (r.label, r.margin, r.score) for r in fear.predict_fear(frame, weights, "id").collect()}
    assert found[1] == ("Fear_Mongering", 3.0, pytest.approx(1 / (1 + math.exp(-3))))
    assert found[2] == found[3] == ("Not_Fear_Mongering", 0.0, 0.5)
    assert found[4][:2] == ("Not_Fear_Mongering", -1.0)
    empty = frame.limit(0)
    assert fear.predict_fear(empty, weights, "id").collect() == []
    nothing = fear.fit_fear_weights(empty.withColumnRenamed("score", "label"))
    assert nothing.collect() == []


def test_trained_weights_beat_the_list_on_held_out_documents(spark):
    rows = catalog.QUERIES["fear_scorer_accuracy"](spark, "/root/testdata/sf0.01").collect()
    accuracy = {r.model: r.accuracy for r in rows}
    print(rows)
    assert accuracy["weights"] > accuracy["word list"]
