"""A table in which every user has seen every business leaves no negatives to draw."""

import pytest

from reviewloom.operators import sampling
from reviewloom.plans.preparation import Settings, prepare, training_set

IDS = "user_id int, business_id string, review_id int"


def test_training_set_where_every_pair_is_seen(spark):
    rows = [(u, b, 10 * u + i, "soup bread") for u in (1, 2) for i, b in enumerate("abab")]
    reviews = spark.createDataFrame(rows, f"{IDS}, review_text string")
    vocabulary = spark.createDataFrame([("soup", 1), ("bread", 0)], "word string, idx bigint")
    vectors = spark.createDataFrame([("soup", [1.0, 0.0]), ("bread", [0.5, 2.0])], "word string, vec array<double>")
    prepared = prepare(reviews, vocabulary, vectors, Settings(2))
    assert prepared.unseen.count() == 0
    assert [r["y"] for r in training_set(prepared).collect()] == [1] * 8
    assert sampling.unseen_pairs(reviews, none_left=True).count() == 0
    with pytest.raises(ValueError):
        sampling.unseen_pairs(reviews)
