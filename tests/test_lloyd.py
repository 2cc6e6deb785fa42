"""Steps of Lloyd's method against numpy."""

import numpy as np
from pyspark.sql import functions as F

from reviewloom.operators import lloyd


def plain(points, first, steps):
    middles = [points[i] for i in first]
    for step in range(steps + 1):
        gaps = np.array([[np.round(((p - m) ** 2).sum(), 9) for m in middles] for p in points])
        group = gaps.argmin(axis=1)
        if step < steps:
            middles = [points[group == g].mean(axis=0) if (group == g).any() else m for g, m in enumerate(middles)]
    return group.tolist()


def test_steps_equal_numpy(spark):
    draw = np.random.default_rng(4)
    points = draw.normal(size=(300, 5)) + 4 * draw.integers(0, 3, (300, 1))
    points[10:40] = points[9]  # repeated rows, ties of seeds among them
    rows = spark.createDataFrame([(n, p.tolist()) for n, p in enumerate(points)], "id bigint, vec array<double>")
    seeds = rows.orderBy(lloyd.fast_hash(F.col("id").cast("string"), "seed"), F.col("id").cast("string")).limit(7)
    first = [r.id for r in seeds.collect()]
    found = {r.id: r.group for r in lloyd.lloyd(rows, "id", "vec", 5, 7, steps=4).collect()}
    assert [found[n] for n in range(300)] == plain(points, first, 4)


def test_few_and_no_points(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [5.0, 1.0])], "id bigint, vec array<double>")
    assert sorted(r.group for r in lloyd.lloyd(rows, "id", "vec", 2, 5, steps=2).collect()) == [0, 1]
    assert lloyd.lloyd(rows.limit(0), "id", "vec", 2, 5, steps=1).collect() == []
