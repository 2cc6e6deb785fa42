"""All registered queries in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.plans import queries_ids, queries_models, queries_text, queries_vectors
from reviewloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "top_words_by_source"]


def top_words_by_source(spark: SparkSession, folder: str, top: int = 20) -> DataFrame:
    """The ``top`` words of each source by TF-IDF; ties go by the word.

    Ranking within the source keeps only ``top`` rows per source and input partition
    before the shuffle, because the filter on the rank limits the window.
    """
    weights = queries_text.tfidf_by_source(spark, folder)
    order = Window.partitionBy("source").orderBy(F.col("weight").desc(), "word")
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
