"""From the raw files to an evaluated classifier, in one call."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.fixed_values import STOP_WORDS
from reviewloom.operators.durable import stored
from reviewloom.operators.groups import group_keywords
from reviewloom.operators.ids import add_review_ids
from reviewloom.operators.learning import model_vectors, train_word_vectors
from reviewloom.operators.tfidf import keywords_per_label
from reviewloom.operators.vocabulary import build_vocabulary, lexicon, spell_words
from reviewloom.plans.modelling import Evaluation, baseline, deep_learning, entity_groups, evaluate
from reviewloom.plans.preparation import Settings, prepare
from reviewloom.sources import recipes, reviews, vectors


@dataclass(frozen=True)
class Files:
    """Where the raw files are, and where what is made of them is kept.

    ``recipes`` is a CSV path, ``reviews`` a printed file, in the FILTER or FULL
    ``variant``. With ``fit`` the JSON lines of the reviews and what is learned from the
    recipe ``columns`` are made and kept in ``kept``; without it they are loaded from there.
    The vocabulary has the words within ``min_df`` and ``max_df`` (numbers of recipes, or
    shares of them) that are no ``stop_words``.
    """

    recipes: str
    reviews: str
    kept: str
    columns: Sequence[str] = ("ingredients", "name")
    variant: str = "FILTER"
    window: int = 5
    fit: bool = True
    min_df: int | float = 1
    max_df: int | float = 1.0
    stop_words: Sequence[str] = STOP_WORDS
    settings: Settings = field(default_factory=lambda: Settings(vector_size=100))


def _learn(spark: SparkSession, files: Files, vocabulary: str, model: str) -> None:
    rows = recipes.read_recipes(spark, files.recipes)
    lists = recipes.recipe_word_lists(rows, files.columns)
    words = build_vocabulary(lists, "text", files.stop_words, files.min_df, files.max_df)
    recipes.save_table(words, vocabulary)
    size = files.settings.vector_size
    recipes.save_model(train_word_vectors(lists, "words", size, files.window), model)


def learned(spark: SparkSession, files: Files) -> tuple[DataFrame, DataFrame]:
    """The vocabulary, and the vectors of its words."""
    vocabulary, model, table = (
        recipes.artefact_path(files.kept, kind, files.columns)
        for kind in ("vocabulary", "word2vec", "vectors")
    )
    if files.fit:
        _learn(spark, files, vocabulary, model)
        words = lexicon(recipes.load_table(spark, vocabulary), files.stop_words)
        found = model_vectors(recipes.load_word_vectors(model))
        recipes.save_table(vectors.lexicon_vectors(found, words), table)
    return recipes.load_table(spark, vocabulary), recipes.load_table(spark, table)


def numbered_reviews(spark: SparkSession, files: Files) -> DataFrame:
    """The reviews with their ids as they are: joins and sums take ids of any type."""
    lines = f"{files.kept}/lines"
    if files.fit:
        reviews.literal_to_json_lines(spark, files.reviews, lines)
    return add_review_ids(reviews.read_review_lines(spark, lines, files.variant).drop("pics"))


def evaluated(spark: SparkSession, files: Files, network: bool = False) -> Evaluation:
    """The classifier (or the neural ``network``) trained and scored on the files."""
    vocabulary, word_vectors = learned(spark, files)
    prepared = prepare(numbered_reviews(spark, files), vocabulary, word_vectors, files.settings)
    scored = deep_learning(prepared, files.settings) if network else baseline(prepared)
    return evaluate(scored)


def reported(spark: SparkSession, files: Files, entity: str, k: int, top: int = 500) -> DataFrame:
    """``arg_position``, ``arg_label``, ``words``: the telling words of ``k`` groups of users or
    businesses, by the mean vectors that the files give them."""
    vocabulary, word_vectors = learned(spark, files)
    prepared = prepare(numbered_reviews(spark, files), vocabulary, word_vectors, files.settings)
    entities = prepared.users if entity == "user" else prepared.businesses
    groups = stored(entity_groups(entities, entity, k, files.settings.vector_size), "groups")
    codes = vocabulary.select(F.col("idx").alias("word"))
    found = group_keywords(prepared.counts, groups, codes, entity, top)
    return keywords_per_label(spell_words(found, vocabulary))
