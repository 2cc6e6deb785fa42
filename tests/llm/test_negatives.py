"""Hard negatives against plain integers, and tables that are odd."""

import math

import numpy as np
import pytest

from reviewloom.llm import negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(rows, every=50, scale=256):
    fine = []
    for at, (key, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        fine.append((key, at, label, [math.floor(scale * x) for x in vector]))
    found = []
    for key, at, label, vector in fine:
        if key is None or key % every:
            continue
        scored = [
            (-sum(x * y for x, y in zip(vector, own, strict=False)), other is None, other or 0, place, kind)
            for other, place, kind, own in fine
            if place != at
        ]
        scored.sort()
        nearest = [x for x in scored if x[4] == label][:5]
        for score, none, positive, *_ in nearest:
            passed = [x for x in scored if x[4] != label and -50 * score <= -100 * x[0] <= -95 * score][:3]
            for rank, x in enumerate(passed, 1):
                found.append((key, None if none else positive, rank, None if x[1] else x[2], -score, -x[0]))
    return sorted(found, key=repr)


def found(spark, rows, schema=SCHEMA, **more):
    table = spark.createDataFrame(rows, schema)
    return sorted(map(tuple, negatives.hard_negatives(table, **more).collect()), key=repr)


@pytest.mark.parametrize("size", [1, 7, 40])
def test_equals_plain_integers(spark, size):
    draw = np.random.default_rng(size)
    centres = draw.normal(size=(6, size))
    rows = []
    for n in range(400):
        vector = centres[draw.integers(6)] + 0.4 * draw.normal(size=size)
        rows.append((int(n), (vector / 4).tolist(), int(draw.integers(3))))
    expected = plain(rows)
    assert expected and found(spark, rows) == expected


def test_odd_rows(spark):
    near, far = [0.5, 0.25], [0.4, 0.2]
    rows = [(0, near, 1), (0, near, 1), (50, far, 2), (50, far, 1), (3, near, 2), (4, near, 2), (None, far, 2), (None, near, 1)]
    rows += [(n, far, 2) for n in range(200, 230)] + [(n, near, 1) for n in range(300, 330)]
    odd = [(100, None, 1), (150, near, None), (7, [None, 1.0], 1), (8, [float("nan"), 1.0], 1), (9, [float("inf"), 0.0], 2)]
    odd += [(1000, [], 1), (1050, [0.5], 2), (1100, [-0.5, 0.1], 5)]
    assert found(spark, rows + odd) == plain(rows + odd)


def test_components_beyond_the_bound_take_no_part(spark):
    rows = [(0, [0.5], 1), (1, [0.5], 1), (2, [0.45], 2)]
    assert found(spark, rows + [(3, [1e300], 2), (4, [-1e30], 1)]) == plain(rows)


def test_empty_table_and_other_columns(spark):
    assert found(spark, []) == []
    rows = [(0, [0.5], 1), (1, [0.5], 1), (2, [0.45], 2)]
    wide = [(*row, "x", 5, 6.0, 7) for row in rows]
    schema = SCHEMA + ", row string, anchor int, score double, rank int"
    assert found(spark, wide, schema) == plain(rows)


def test_bounds_keep_what_counts():
    draw = np.random.default_rng(9)
    scores = draw.integers(-50, 50, 300).astype(float)
    slack = draw.integers(0, 30, 300)
    lower, upper = scores - slack, scores + draw.integers(0, 30, 300)
    on = negatives.among_first(5)(lower, upper)
    assert set(np.argsort(-scores, kind="stable")[:5]) <= set(np.flatnonzero(on)) and not on.all()
    windows = [(10.0, 20.0), (-5.0, 3.0), (200.0, 100.0)]
    on = negatives.in_windows(windows, 3)(lower, upper)
    for low, high in windows:
        inside = np.flatnonzero((scores >= low) & (scores <= high))
        assert set(inside[np.argsort(-scores[inside], kind="stable")[:3]]) <= set(np.flatnonzero(on))
