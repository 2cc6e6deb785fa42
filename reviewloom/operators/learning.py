"""Models: word vectors, classifiers, principal components, groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, StandardScaler, Word2Vec, Word2VecModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import vectors as V
from reviewloom.operators.stats import threshold


def train_word_vectors(
    texts: DataFrame,
    words: str,
    size: int = 100,
    window: int = 3,
    min_count: int = 1,
    seed: int = 1,
    partitions: int | None = None,
    iterations: int = 5,
) -> Word2VecModel:
    """Word vectors from a column of word lists, by default in as many tasks as there are cores."""
    partitions = partitions or texts.sparkSession.sparkContext.defaultParallelism
    trainer = Word2Vec(
        vectorSize=size,
        windowSize=window,
        minCount=min_count,
        seed=seed,
        numPartitions=partitions,
        maxIter=iterations,
        inputCol=words,
        outputCol="vec",
    )
    return trainer.fit(texts.select(words))


def model_vectors(model: Word2VecModel) -> DataFrame:
    """``word`` and ``vec`` (array of double) of a trained model."""
    return model.getVectors().select("word", vector_to_array("vector").alias("vec"))


def with_features(rows: DataFrame, vector: Column) -> DataFrame:
    """Add ``features`` for the learners; rows with an undefined component are left out."""
    defined = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return rows.where(defined).withColumn("features", array_to_vector(vector))


def balance_weights(rows: DataFrame, label: str = "y") -> DataFrame:
    """Add ``class_weight``: all rows / (number of classes * rows of the class)."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n")).scalar()
    classes = sizes.agg(F.count("*")).scalar()
    # One row per class.
    weights = F.broadcast(sizes)
    return (
        rows.join(weights, label)
        .withColumn("class_weight", total / (classes * F.col("_n")))
        .drop("_n")
    )


@dataclass(frozen=True)
class LogisticModel:
    """The chance of class 1 is ``1 / (1 + exp(-(coefficients * features + intercept)))``."""

    coefficients: tuple[float, ...]
    intercept: float


# The sums of the tasks are added up in so many groups before they come together.
_SUM_GROUPS = 64


def _logistic_sums(rows: DataFrame, point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature of the loss of all rows, without the penalty.

    ``point`` holds the coefficients, then the intercept. Each task turns its rows into one
    sum as wide as the squared number of features; no row leaves its task.
    """
    size = len(point)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + size + size * size)
        for batch in batches:
            if len(batch):
                given = np.column_stack([np.stack(batch["x"].to_numpy()), np.ones(len(batch))])
                y, weight = batch["y"].to_numpy(np.float64), batch["class_weight"].to_numpy(np.float64)
                line = given @ point
                chance = np.exp(-np.logaddexp(0.0, -line))
                total[0] += weight @ (np.logaddexp(0.0, line) - y * line)
                total[1 : 1 + size] += given.T @ (weight * (chance - y))
                curve = given.T @ (given * (weight * chance * (1.0 - chance))[:, None])
                total[1 + size :] += curve.ravel()
        yield pd.DataFrame({"sums": [total.tolist()]})

    sums = rows.mapInPandas(add_up, "sums array<double>")
    sums = sums.select(array_to_vector("sums").alias("sums"), (F.spark_partition_id() % _SUM_GROUPS).alias("part"))
    sums = sums.groupBy("part").agg(Summarizer.sum(F.col("sums")).alias("sums"))
    # One row, as wide as the squared number of features.
    found = sums.agg(Summarizer.sum(F.col("sums")).alias("sums")).first()["sums"].toArray()
    return found[0], found[1 : 1 + size], found[1 + size :].reshape(size, size)


def fit_logistic_regression(
    train: DataFrame, label: str = "y", c: float = 1.0, max_iter: int = 100, balanced: bool = True
) -> LogisticModel:
    """Logistic regression with an L2 penalty ``|b|^2 / 2`` beside ``c`` times the loss.

    Newton steps, halved while the sum of both grows, until no part of the gradient is above
    1e-9 of the rows' weight (or rounding lets the sum fall no further). The intercept is not
    penalised. Rows without a label are left out; without rows the model is all zeros.
    """
    rows = train.select(label, "features").where(F.col(label).isNotNull()).withColumn("class_weight", F.lit(1.0))
    if balanced:
        rows = balance_weights(rows.drop("class_weight"), label)
    rows = rows.select(
        vector_to_array("features").alias("x"),
        F.col(label).cast("double").alias("y"),
        F.col("class_weight").cast("double").alias("class_weight"),
    )
    size = rows.agg(F.max(F.size("x")), F.sum("class_weight")).first()
    if size[0] is None:
        return LogisticModel((), 0.0)
    penalty = np.append(np.ones(size[0]), 0.0)
    point, step, least = np.zeros(size[0] + 1), None, np.inf
    for _ in range(max_iter):
        loss, slope, curve = _logistic_sums(rows, point)
        whole = c * loss + 0.5 * penalty @ point**2
        if step is not None and whole > least + 1e-12 * abs(least):
            step = 0.5 * step
            if np.abs(step).max() <= 1e-12 * (1.0 + np.abs(point).max()):
                break
            point = point - step
            continue
        least = whole
        slope = c * slope + penalty * point
        if np.abs(slope).max() <= 1e-9 * c * size[1]:
            break
        step = -np.linalg.lstsq(c * curve + np.diag(penalty), slope, rcond=None)[0]
        point = point + step
    return LogisticModel(tuple(point[:-1].tolist()), float(point[-1]))


def fit_neural_network(
    train: DataFrame,
    inputs: int,
    label: str = "y",
    hidden: Sequence[int] = (50, 100),
    max_iter: int = 100,
    seed: int = 1,
) -> MultilayerPerceptronClassificationModel:
    """A small feed-forward network with one output per class."""
    learner = MultilayerPerceptronClassifier(
        labelCol=label, layers=[inputs, *hidden, 2], maxIter=max_iter, seed=seed
    )
    return learner.fit(train.select(label, "features"))


def scores(model, rows: DataFrame) -> DataFrame:
    """Add the ``score`` of class 1 and the ``predicted`` class."""
    if isinstance(model, LogisticModel):
        line = V.dot(vector_to_array("features"), F.lit(list(model.coefficients))) + F.lit(model.intercept)
        chance = rows.withColumn("score", 1.0 / (1.0 + F.exp(-line)))
        return chance.withColumn("predicted", threshold(F.col("score")))
    scored = model.transform(rows)
    score = F.get(vector_to_array("probability"), F.lit(1))
    return (
        scored.withColumn("score", score)
        .withColumn("predicted", threshold(F.col("score")))
        .drop("rawPrediction", "probability", "prediction")
    )


def fit_components(rows: DataFrame, k: int) -> PipelineModel:
    """The first ``k`` principal components of ``features``, centred first."""
    centred = StandardScaler(
        inputCol="features", outputCol="centred", withMean=True, withStd=False
    )
    return Pipeline(stages=[centred, PCA(k=k, inputCol="centred", outputCol="components")]).fit(
        rows.select("features")
    )


def explained_variance(model: PipelineModel) -> list[float]:
    """The share of all variance that each principal component explains."""
    return model.stages[-1].explainedVariance.toArray().tolist()


def fit_groups(rows: DataFrame, k: int, seed: int = 1) -> KMeansModel:
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="group").fit(
        rows.select("features")
    )


def assign_groups(model: KMeansModel, rows: DataFrame) -> DataFrame:
    """Add the ``group`` of each row."""
    return model.transform(rows)
