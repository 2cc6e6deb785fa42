"""TF-IDF as joins and aggregates on long tables of document, word and number.

The weight of a word in a document is ``r / sqrt(sum of r * r in the document)`` with
``r = tf * (ln((1 + documents) / (1 + documents with the word)) + 1)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.text import clean_text, word_tokens
from reviewloom.operators.durable import dealt, joined, lookup, stored, stored_lookup
from reviewloom.operators.ordering import numbered


def text_word_counts(
    documents: DataFrame, key: str, text: Column, usable: DataFrame | None = None
) -> DataFrame:
    """``key``, ``word``, ``tf`` of the words of a text; only usable words if given."""
    words = documents.where(F.col(key).isNotNull()).select(
        key, F.explode(word_tokens(text)).alias("word")
    )
    if usable is not None:
        words = words.join(lookup(usable.select("word")), "word", "left_semi")
    return words.groupBy(key, "word").agg(F.count("*").alias("tf"))


def raw_weights(
    counts: DataFrame, key: str, documents: DataFrame | None = None
) -> DataFrame:
    """Add ``df`` and ``r`` to the stored table ``key``, ``word``, ``tf``.

    ``documents`` holds one row per document, where documents without words count too.
    """
    if documents is None:
        documents = counts.select(key).distinct()
    total = documents.agg(F.count("*")).scalar()
    words = dealt(counts.select("word"), "word").groupBy("word")
    frequencies = stored(words.agg(F.count("*").alias("df")), "df")
    idf = F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    found = joined(counts, frequencies, ["word"])
    return found.select(key, "word", "tf", "df", (F.col("tf") * idf).alias("r"))


def document_lengths(raw: DataFrame, key: str) -> DataFrame:
    """The length of each document's vector of raw weights.

    This is an aggregate to be joined back instead of a window, since one document (a
    user, a business, a source) may hold a large part of all words.
    """
    return raw.groupBy(key).agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("length"))


def weigh(counts: DataFrame, key: str, documents: DataFrame | None = None) -> DataFrame:
    """Add ``df`` and ``weight`` to the stored table ``key``, ``word``, ``tf``."""
    raw = raw_weights(counts, key, documents)
    lengths = stored_lookup(document_lengths(raw, key), "lengths")
    return raw.join(lengths, key).select(
        key, "word", "tf", "df", (F.col("r") / F.col("length")).alias("weight")
    )


def document_weights(
    documents: DataFrame, key: str, text: str, usable: DataFrame | None = None
) -> DataFrame:
    """TF-IDF of every document (row) over a fixed set of words."""
    counts = stored(text_word_counts(documents, key, F.col(text), usable), "doc-words")
    return weigh(counts, key, documents.select(key))


def label_weights_joined(
    reviews: DataFrame, label: str, text: str, usable: DataFrame | None = None
) -> DataFrame:
    """TF-IDF of every label, taking all its texts as one document."""
    labelled = reviews.where(F.col(label).isNotNull())
    counts = text_word_counts(labelled, label, clean_text(F.col(text)), usable)
    return weigh(stored(counts, "label-words"), label, labelled.select(label).distinct())


def label_weights_averaged(
    reviews: DataFrame, key: str, label: str, text: str, usable: DataFrame | None = None
) -> DataFrame:
    """``label``, ``word``, ``weight``: the mean TF-IDF over the rows of the label."""
    cleaned = reviews.select(key, label, clean_text(F.col(text)).alias("_text"))
    weights = document_weights(cleaned, key, "_text", usable).select(key, "word", "weight")
    rows = cleaned.where(F.col(label).isNotNull()).select(key, label)
    sums = (
        weights.join(rows, key)
        .groupBy(label, "word")
        .agg(F.sum("weight").alias("total"))
    )
    sizes = stored_lookup(rows.groupBy(label).agg(F.count("*").alias("rows")), "sizes")
    return sums.join(sizes, label).select(
        label, "word", (F.col("total") / F.col("rows")).alias("weight")
    )


def label_positions(rows: DataFrame, label: str, order: str) -> DataFrame:
    """The labels with their ``position`` by first appearance in the given order."""
    first = (
        rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(order).alias("first"))
    )
    return numbered(first, ["first", label], "position").drop("first")


def word_labels(
    weights: DataFrame, label: str, positions: DataFrame, vocabulary: DataFrame
) -> DataFrame:
    """For every word of the vocabulary its strongest label and its spread over all labels.

    A label without the word counts with weight 0. Such cells are never made: the words of
    a label are few beside the grid of all words and labels, and what a zero adds to the
    sums is known. Ties (weights that agree to nine digits) go to the label that appears
    first, and the first label stands for a word without any weight.
    """
    labels = positions.agg(F.count("*")).scalar()
    placed = weights.join(lookup(positions), label)
    # The variance of the labels with the word, and what the zeros of the others add to it:
    # no difference of large sums, so equal weights have no spread at all.
    present = F.count("weight")
    absent = (labels - present) / F.lit(labels)
    between = present * absent * F.avg("weight") * F.avg("weight")
    variance = (present * F.var_pop("weight") + between) / labels
    strongest = F.max_by(
        F.struct("position", F.col(label).alias("label")),
        F.struct(F.round("weight", 9), -F.col("position")),
    )
    known = placed.groupBy("word").agg(
        strongest.alias("best"),
        F.sqrt(variance).alias("stdev"),
    )
    first = positions.where(F.col("position") == 0).select(label).scalar()
    return (
        vocabulary.select("word")
        .join(known, "word", "left")
        .select(
            "word",
            F.coalesce("best.position", F.lit(0)).alias("arg_position"),
            F.coalesce("best.label", first).alias("arg_label"),
            F.coalesce("stdev", F.lit(0.0)).alias("stdev"),
        )
    )


def word_label_table(
    word_label: DataFrame, weights: DataFrame, label: str, labels: Sequence[str]
) -> DataFrame:
    """:func:`word_labels` with one more column per given label: the weight there, or 0."""
    wide = weights.groupBy("word").pivot(label, list(labels)).agg(F.first("weight"))
    return word_label.join(wide, "word", "left").na.fill(0.0, list(labels))


def top_words(word_label: DataFrame, top: int = 500) -> DataFrame:
    """The ``top`` words of widest spread with their rank; ties go by the word.

    Spreads that agree to nine digits count as equal, so that the order in which sums were
    added does not decide.
    """
    order = [F.round("stdev", 9).desc(), F.col("word")]
    best = word_label.orderBy(*order).limit(top)
    # At most ``top`` rows, so one place may number them.
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def keywords_per_label(top: DataFrame) -> DataFrame:
    """The top words of each label as one list, best first."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "word")))
    return top.groupBy("arg_position", "arg_label").agg(
        F.transform(ranked, lambda entry: entry["word"]).alias("words")
    )
