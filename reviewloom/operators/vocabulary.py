"""Vocabularies, lexicons and word lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.fixed_values import PLAIN_NEGATIONS, STOP_WORDS
from reviewloom.functions.text import word_tokens
from reviewloom.operators.durable import joined, lookup
from reviewloom.operators.ordering import numbered


def word_document_counts(documents: DataFrame, text: str) -> DataFrame:
    """In how many documents (rows) each word occurs: ``word``, ``df``.

    Repeats go away inside the row, so that only one count per word and input partition is
    shuffled, never the pairs of document and word.
    """
    words = documents.select(F.explode(F.array_distinct(word_tokens(F.col(text)))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("df"))


def _document_limit(documents: DataFrame, limit: int | float) -> Column:
    """A whole number is a count of documents, a float a share of them."""
    if isinstance(limit, int):
        return F.lit(limit)
    return F.lit(limit) * documents.agg(F.count("*")).scalar()


def build_vocabulary(
    documents: DataFrame,
    text: str,
    stop_words: Iterable[str] = STOP_WORDS,
    min_df: int | float = 1,
    max_df: int | float = 1.0,
) -> DataFrame:
    """``word``, ``df`` and the alphabetical ``idx`` of the words within both limits."""
    kept = without_words(word_document_counts(documents, text), stop_words).where(
        (F.col("df") >= _document_limit(documents, min_df))
        & (F.col("df") <= _document_limit(documents, max_df))
    )
    return numbered(kept, ["word"], "idx")


def index_words(words: DataFrame) -> DataFrame:
    """A given list of words as a vocabulary: ``word`` and its alphabetical ``idx``."""
    return numbered(words.select("word").distinct(), ["word"], "idx")


def without_words(words: DataFrame, excluded: Iterable[str]) -> DataFrame:
    """The rows whose word is not in a short fixed list."""
    return words.where(~F.col("word").isin(list(excluded)))


def lexicon(vocabulary: DataFrame, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """The words of a vocabulary that are no stop words."""
    return without_words(vocabulary.select("word"), stop_words)


def usable_words(
    vocabulary: DataFrame, vectors: DataFrame, stop_words: Iterable[str] = STOP_WORDS
) -> DataFrame:
    """The rows of the vocabulary that review words are kept for.

    Their words have a vector, at least one character, and are no stop words. Deciding
    that once per dictionary word leaves a single lookup per word of a review.
    """
    return (
        without_words(vocabulary, stop_words)
        .where(F.col("word") != "")
        .join(vectors.select("word"), "word", "left_semi")
    )


def code_words(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Replace each ``word`` by its index; words outside the vocabulary drop out."""
    codes = lookup(vocabulary.select("word", F.col("idx").alias("_code")))
    return rows.join(codes, "word").withColumn("word", F.col("_code")).drop("_code")


def spell_words(rows: DataFrame, vocabulary: DataFrame, number: int | None = None) -> DataFrame:
    """The inverse of :func:`code_words`; ``number`` is at least that of the rows, if known."""
    words = vocabulary.select(F.col("idx").alias("word"), F.col("word").alias("_text"))
    return joined(rows, words, ["word"], number=number).withColumn("word", F.col("_text")).drop("_text")


def negation_words(stop_words: DataFrame) -> DataFrame:
    """The plain negations, the stop words that end in ``'t``, and these without it."""
    contractions = stop_words.select("word").where(F.col("word").endswith("'t"))
    stems = contractions.select(F.expr("left(word, length(word) - 2)").alias("word"))
    spark = stop_words.sparkSession
    plain = spark.createDataFrame([(word,) for word in PLAIN_NEGATIONS], "word string")
    return plain.unionByName(contractions).unionByName(stems)
