"""K-means by exact steps: seeds by hash, then a fixed number of turns of Lloyd's method.

Nothing is drawn at random and nothing depends on the order of rows, so reruns and other
engines come to the same groups. A step reads the points once; a centre whose length alone
tells that it is farther than the best so far is skipped (the triangle inequality).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators.durable import stored
from reviewloom.operators.sampling import Hash, fast_hash
from reviewloom.operators.similarity import centres

# Distances that agree to so many digits are ties, which the smaller number of a group wins.
DIGITS = 9
_MARGIN = 1e-6


def _length(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))


def seeds(points: DataFrame, key: str, vector: str, k: int, hashed: Hash = fast_hash) -> DataFrame:
    """``centre`` (from 0) and ``vec``: the first ``k`` points by the hash of their key."""
    turn = hashed(F.col(key).cast("string"), "seed")
    first = points.select(turn.alias("turn"), F.col(key).cast("string").alias("name"), F.col(vector).alias("vec"))
    first = first.orderBy("turn", "name").limit(k)
    number = F.row_number().over(Window.orderBy("turn", "name")) - 1
    return first.select(number.alias("centre"), "vec")


def nearest(points: DataFrame, vector: str, middles: DataFrame, name: str = "group") -> DataFrame:
    """Add the number of the nearest centre; ``middles`` are the ``centre`` and ``vec`` of k groups."""
    gathered = middles.agg(
        F.sort_array(F.collect_list(F.struct("centre", _length(F.col("vec")).alias("length"), "vec")))
    )
    point, length = F.col(vector), F.col("_length")

    def closer(best: Column, centre: Column) -> Column:
        gaps = F.zip_with(point, centre["vec"], lambda x, y: (x - y) * (x - y))
        distance = F.round(F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap), DIGITS)
        apart = length - centre["length"]
        own = F.struct(distance.alias("distance"), centre["centre"].alias("centre"))
        return F.when(apart * apart > best["distance"] + F.lit(_MARGIN), best).otherwise(F.least(best, own))

    start = F.struct(F.lit(float("inf")).alias("distance"), F.lit(-1).alias("centre"))
    ready = points.withColumn("_centres", gathered.scalar()).withColumn("_length", _length(point))
    found = ready.withColumn(name, F.aggregate("_centres", start, closer)["centre"])
    return found.drop("_centres", "_length")


def lloyd(
    points: DataFrame, key: str, vector: str, size: int, k: int, steps: int = 10, hashed: Hash = fast_hash
) -> DataFrame:
    """``key`` and ``group`` (0 to k - 1) of every point, after ``steps`` moves of the centres.

    Fewer points than ``k`` are groups of their own. A centre without points stays where it
    is. ``points`` is a written table without undefined vectors; the centres are one row for
    each group.
    """
    middles = stored(seeds(points, key, vector, k, hashed), "seeds")
    for _ in range(steps):
        placed = nearest(points.select(key, vector), vector, middles)
        moved = centres(placed, "group", vector, size).select(F.col("centre").alias("_centre"), F.col("vec").alias("_vec"))
        # One row for each group.
        both = middles.join(F.broadcast(moved), F.col("centre") == F.col("_centre"), "left")
        middles = stored(both.select("centre", F.coalesce("_vec", "vec").alias("vec")), "centres")
    return nearest(points.select(key, vector), vector, middles).select(key, "group")
