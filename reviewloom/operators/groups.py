"""The most telling words of groups of users or businesses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.durable import dealt, lookup, stored, stored_lookup
from reviewloom.operators.entity_vectors import entity_word_weights
from reviewloom.operators.tfidf import label_positions, top_words, weigh, word_labels


def group_word_counts(counts: DataFrame, groups: DataFrame, entity: str) -> DataFrame:
    """``group``, ``word``, ``tf`` for all entities of each group (one row per entity).

    A group's text is never put together: its words are only counted, dealt by group and word.
    """
    labelled = attach_groups(counts.select(f"{entity}_id", "word", "n"), groups, entity)
    words = dealt(labelled, "group", "word", number=counts.count()).groupBy("group", "word")
    return words.agg(F.sum("n").alias("tf"))


def averaged_group_weights(counts: DataFrame, groups: DataFrame, entity: str) -> DataFrame:
    """``group``, ``word``, ``weight``: the mean TF-IDF over the entities of the group.

    ``groups`` has one row per entity that has words; those without a word count with 0.
    """
    key = f"{entity}_id"
    weights = entity_word_weights(counts, entity).select(key, "word", "weight")
    sizes = groups.groupBy("group").agg(F.count("*").alias("members"))
    rows = dealt(attach_groups(weights, groups, entity), "group", "word", number=counts.count())
    sums = rows.groupBy("group", "word").agg(F.sum("weight").alias("total"))
    # One row per group.
    return sums.join(stored_lookup(sizes, "group-sizes"), "group").select(
        "group", "word", (F.col("total") / F.col("members")).alias("weight")
    )


def group_keywords(
    counts: DataFrame,
    groups: DataFrame,
    vocabulary: DataFrame,
    entity: str,
    top: int = 500,
    averaged: bool = False,
) -> DataFrame:
    """``arg_position``, ``arg_label``, ``rank``, ``word`` of the most telling words.

    All texts of a group make one document, or, ``averaged``, each entity makes one and the
    group has the mean of their weights. Groups are numbered by their first entity, and
    each of the ``top`` words of widest spread is listed under its strongest group.
    """
    key = f"{entity}_id"
    present = groups.join(counts.select(key).distinct(), key, "left_semi")
    positions = stored(
        label_positions(present.withColumn("group", F.col("group").cast("int")), "group", key),
        "positions",
    )
    if averaged:
        weights = stored(averaged_group_weights(counts, present, entity), "group-weights")
    else:
        tf = stored(group_word_counts(counts, groups, entity), "group-words")
        weights = weigh(tf, "group", positions.select("group"))
    best = word_labels(weights, "group", positions, vocabulary)
    return top_words(best, top).select("arg_position", "arg_label", "rank", "word")


def attach_groups(words: DataFrame, groups: DataFrame, entity: str) -> DataFrame:
    """The words of each entity with the group of the entity."""
    key = f"{entity}_id"
    labels = groups.select(key, F.col("group").cast("int").alias("group"))
    return words.join(lookup(labels), key)
