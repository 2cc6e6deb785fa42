"""Train on three quarters of the pairs, score the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.durable import stored
from reviewloom.operators.learning import (
    fit_logistic_regression,
    fit_neural_network,
    scores,
    with_features,
)
from reviewloom.operators.lloyd import lloyd
from reviewloom.operators.sampling import PAIR, Hash, fast_hash, stratified_split
from reviewloom.operators.stats import area_under_roc, confusion_matrix
from reviewloom.plans.preparation import Prepared, Settings, training_set


def split_training_set(
    prepared: Prepared, concatenated: bool, hashed: Hash = fast_hash
) -> tuple[DataFrame, DataFrame]:
    """Features and ``y`` for training and for validation (``stored``).

    Pairs with undefined features leave before the split, so its shares hold for the rest.
    """
    rows = with_features(training_set(prepared, concatenated), F.col("x")).drop("x")
    rows = stored(rows, "training")
    split = stored(stratified_split(rows, "y", "key", hashed=hashed), "split")
    return split.where(~F.col("held_out")), split.where("held_out")


def baseline(prepared: Prepared) -> DataFrame:
    """Logistic regression on vector products: the scored validation rows."""
    train, held_out = split_training_set(prepared, concatenated=False)
    return scores(fit_logistic_regression(train), held_out)


def deep_learning(prepared: Prepared, settings: Settings, max_iter: int = 100) -> DataFrame:
    """The neural network on concatenated vectors: the scored validation rows."""
    train, held_out = split_training_set(prepared, concatenated=True)
    model = fit_neural_network(train, 2 * settings.vector_size, max_iter=max_iter)
    return scores(model, held_out)


@dataclass(frozen=True)
class Evaluation:
    """The scored validation rows (stored), their confusion matrix, and the AUC."""

    scored: DataFrame
    confusion: DataFrame
    auc: DataFrame


def evaluate(scored: DataFrame) -> Evaluation:
    scored = stored(scored.select("key", *PAIR, "y", "score", "predicted"), "scores")
    return Evaluation(
        scored,
        confusion_matrix(scored, "y", "predicted"),
        area_under_roc(scored, "y", "score"),
    )


def entity_groups(
    entities: DataFrame, entity: str, k: int, size: int, hashed: Hash = fast_hash
) -> DataFrame:
    """Users or businesses in ``k`` groups by their mean vectors: id and ``group``."""
    key, vector = f"{entity}_id", f"{entity}_vec"
    rows = with_features(entities, F.col(vector)).select(key, vector)
    return lloyd(stored(rows, "points"), key, vector, size, k, hashed=hashed)
