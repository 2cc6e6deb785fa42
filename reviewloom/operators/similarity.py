"""Nearest words and nearest centres by vector."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions import vectors as V
from reviewloom.operators.durable import stored
from reviewloom.operators.entity_vectors import vector_sums


def analogy(
    vectors: DataFrame, base: str, version: str, target: str, size: int, top: int = 10
) -> DataFrame:
    """``version`` is to ``base`` as which words are to ``target``?

    The ``top`` words by cosine with ``version - base + target`` (unit vectors, averaged),
    without the three themselves; ties go by the word. Fewer than three known words give
    no row.
    """
    units = vectors.select("word", V.unit(F.col("vec")).alias("vec"))
    given = units.where(F.col("word").isin(base, version, target))
    sign = F.when(F.col("word") == base, -1.0).otherwise(1.0)
    mean = given.agg(
        (F.count("*") == 3).alias("known"), vector_sums(size, times=sign / 3.0).alias("vec")
    )
    query = mean.where("known").select(V.unit(F.col("vec")))
    # The query is one vector, the result of a scalar subquery.
    scored = units.where(~F.col("word").isin(base, version, target)).withColumn(
        "query", query.scalar()
    )
    return (
        scored.select("word", V.dot(F.col("vec"), F.col("query")).alias("similarity"))
        .where(F.col("similarity").isNotNull())
        .orderBy(F.col("similarity").desc(), "word")
        .limit(top)
    )


# Questions in a block and words in a slot, about: a block meets a slot in one task.
QUESTIONS_IN_BLOCK, WORDS_IN_SLOT = 1_024, 8_192
# Questions per matrix product; what products may be off by.
_AT_ONCE, _SLACK = 64, 1e-9


def _usable(vector, size: int):
    return (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) <= 1.0 + _SLACK))


def _best_in_slots(units: DataFrame, asked: DataFrame, size: int, top: int) -> DataFrame:
    """``question``, ``word``, ``similarity``: the ``top`` words of each slot of words.

    Blocks of questions are sent to every slot and words to every block, so that no row holds
    a word and a question. A product of matrices finds the words that may be among the best;
    only their cosines are then added up in the order of the components.
    """
    blocks = max(1, math.ceil(asked.count() / QUESTIONS_IN_BLOCK))
    slots = max(1, math.ceil(units.count() / WORDS_IN_SLOT))

    def each(number: int):
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1)))

    words = units.withColumn("slot", F.pmod("row", F.lit(slots)).cast("int")).withColumn("block", each(blocks))
    block = F.pmod(F.xxhash64("question"), F.lit(blocks)).cast("int")
    questions = asked.withColumn("block", block).withColumn("slot", each(slots))

    def meet(some: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list] = {"question": [], "word": [], "similarity": []}
        if len(some) and len(asking):
            order = np.argsort(some["word"].to_numpy(object), kind="stable")
            names = some["word"].to_numpy(object)[order]
            matrix = np.stack(some["vec"].to_numpy())[order].astype(np.float64)
            places: dict[str, list[int]] = {}
            for place, name in enumerate(names):
                places.setdefault(name, []).append(place)
            wanted = np.stack(asking["vec"].to_numpy()).astype(np.float64)
            keys, given = asking["question"].tolist(), asking["given"].tolist()
            for start in range(0, len(keys), _AT_ONCE):
                products = wanted[start : start + _AT_ONCE] @ matrix.T
                for own, row in enumerate(products, start):
                    row[[place for name in given[own] for place in places.get(name, ())]] = -np.inf
                    least = np.partition(row, -top)[-top] if len(row) > top else -np.inf
                    near = np.flatnonzero((row >= least - _SLACK) & (row > -np.inf))
                    cosines = np.zeros(len(near))
                    for at in range(size):
                        cosines += matrix[near, at] * wanted[own, at]
                    # Places go by the word, so a stable sort leaves equal ones in that order.
                    best = np.argsort(-cosines, kind="stable")[:top]
                    found["question"] += [keys[own]] * len(best)
                    found["word"] += names[near[best]].tolist()
                    found["similarity"] += cosines[best].tolist()
        # Plain objects: a text column of another kind may come in several chunks.
        return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in found.items()})

    kind = asked.schema["question"].dataType.simpleString()
    return (
        words.groupBy("slot", "block")
        .cogroup(questions.groupBy("slot", "block"))
        .applyInPandas(meet, f"question {kind}, word string, similarity double")
    )


def analogies(vectors: DataFrame, questions: DataFrame, size: int, top: int = 10) -> DataFrame:
    """:func:`analogy` for a table: ``question`` (a key), ``base``, ``version``, ``target``.

    Gives ``question``, ``word``, ``similarity``, ``rank``. Blocks of questions meet slots of
    words, and each meeting keeps ``top`` words of a question. Words whose vector is zero, not
    finite or of another length, and questions with an unknown, null or repeated word, give no
    row.
    """
    units = vectors.select("word", V.unit(F.col("vec")).alias("vec"))
    units = units.where(F.col("word").isNotNull() & _usable("vec", size))
    units = stored(units.withColumn("row", F.monotonically_increasing_id()), "units")
    roles = F.array(
        F.struct(F.lit(-1.0).alias("sign"), F.col("base").alias("word")),
        F.struct(F.lit(1.0).alias("sign"), F.col("version").alias("word")),
        F.struct(F.lit(1.0).alias("sign"), F.col("target").alias("word")),
    )
    # One row per question and word of it.
    given = questions.select("question", F.inline(roles)).join(units.drop("row"), "word")
    asked = given.groupBy("question").agg(
        F.collect_set("word").alias("given"),
        vector_sums(size, times=F.col("sign") / 3.0).alias("vec"),
    )
    asked = asked.where(F.size("given") == 3).withColumn("vec", V.unit(F.col("vec")))
    asked = stored(asked.where(_usable("vec", size)), "questions")
    return _best(_best_in_slots(units, asked, size, top), top)


def _best(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("question").orderBy(F.col("similarity").desc(), "word")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def centres(points: DataFrame, label: str, vector: str, size: int) -> DataFrame:
    """The mean vector of each label."""
    sums = points.groupBy(label).agg(
        vector_sums(size, vector).alias("vec"), F.count("*").alias("n")
    )
    return sums.select(
        F.col(label).alias("centre"), V.divide(F.col("vec"), F.col("n")).alias("vec")
    )


# So many centres fit into one array that every task holds.
CENTRES_IN_BLOCK = 10_000


def nearest_centre(
    points: DataFrame, vector: str, centre_vectors: DataFrame, name: str = "centre"
) -> DataFrame:
    """Add the label of the nearest centre (squared Euclidean distance; ties: smallest).

    The centres reach the tasks in blocks, each a single array of about
    ``CENTRES_IN_BLOCK``; the nearest of the blocks' nearest counts.
    """
    blocks = max(1, math.ceil(centre_vectors.count() / CENTRES_IN_BLOCK))
    block = F.pmod(F.xxhash64("centre"), F.lit(blocks))
    point = F.col(vector)

    def distance(centre):
        gaps = F.zip_with(point, centre["vec"], lambda x, y: (x - y) * (x - y))
        return F.struct(
            F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap).alias("distance"),
            centre["centre"].alias("centre"),
        )

    found = points
    for number in range(blocks):
        gathered = centre_vectors.where(block == number).agg(F.collect_list(F.struct("centre", "vec")))
        best = F.array_min(F.transform(F.col("_centres"), distance))
        best = F.least("_nearest", best) if number else best
        found = found.withColumn("_centres", gathered.scalar()).withColumn("_nearest", best)
    return found.withColumn(name, F.col("_nearest.centre")).drop("_centres", "_nearest")
