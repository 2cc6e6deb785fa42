"""Word vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.vectors import as_doubles, gather_vector, split_vector


def lexicon_vectors(vectors: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``word`` and ``vec`` of the words that are in the lexicon."""
    chosen = vectors.select("word", as_doubles(F.col("vec")).alias("vec"))
    return chosen.join(lexicon.select("word"), "word", "left_semi")


def to_columns(vectors: DataFrame, size: int) -> DataFrame:
    """``word`` and one column per component."""
    return vectors.select("word", *split_vector(F.col("vec"), size))


def to_array(vectors: DataFrame, size: int) -> DataFrame:
    """The inverse of :func:`to_columns`."""
    return vectors.select("word", gather_vector(size).alias("vec"))
