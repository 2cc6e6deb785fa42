"""Statistics per group attached to every row, interaction metrics, and scores.

A group may hold a large part of all rows, so groups are never gathered: their totals are
aggregates (partial sums before the shuffle), written and joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.vectors import zero_if_not_finite
from reviewloom.operators.durable import stored, stored_lookup
from reviewloom.operators.ordering import running_sums


def _with_group_totals(rows: DataFrame, group: str, number: str) -> DataFrame:
    value = F.col(number).cast("double")
    totals = (
        rows.where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            F.avg(value).alias("_mean"),
            F.stddev_pop(value).alias("_stdev"),
            (F.min(value) == F.max(value)).alias("_constant"),
            F.count("*").alias("_rows"),
            F.count(value).alias("_values"),
        )
    )
    return rows.join(stored_lookup(totals, "totals"), group, "left")


def _drop_totals(rows: DataFrame) -> DataFrame:
    return rows.drop("_mean", "_stdev", "_constant", "_rows", "_values")


def group_z_scores(rows: DataFrame, group: str, number: str, name: str = "z") -> DataFrame:
    """Distance from the group's mean in population standard deviations.

    0 in a group of equal numbers, also on a row without a number; null on a row without
    a group.
    """
    joined = _with_group_totals(rows, group, number)
    distance = F.try_divide(F.col(number) - F.col("_mean"), F.col("_stdev"))
    return _drop_totals(joined.withColumn(name, F.when(F.col("_constant"), 0.0).otherwise(distance)))


def group_mean_ratios(
    rows: DataFrame, group: str, number: str, name: str = "ratio", all_rows: bool = False
) -> DataFrame:
    """The group's mean divided by its population standard deviation, 0 where undefined.

    With ``all_rows`` the squared deviations are divided by the number of all rows of the
    group, counting those without a number.
    """
    joined = _with_group_totals(rows, group, number)
    stdev: Column = F.col("_stdev")
    if all_rows:
        stdev = stdev * F.sqrt(F.col("_values") / F.col("_rows"))
    ratio = F.when(~F.col("_constant"), F.try_divide(F.col("_mean"), stdev))
    return _drop_totals(joined.withColumn(name, zero_if_not_finite(ratio)))


def distinct_pairs(rows: DataFrame, entity: str, other: str) -> DataFrame:
    """Each entity with each of its counterparts, once: its set, as rows."""
    return rows.where(F.col(entity).isNotNull()).select(entity, other).distinct()


def counterpart_counts(rows: DataFrame, entity: str, other: str) -> DataFrame:
    """How many different counterparts each entity has."""
    return distinct_pairs(rows, entity, other).groupBy(entity).agg(F.count("*").alias("size"))


def _size_frequencies(rows: DataFrame, entity: str, other: str) -> DataFrame:
    # Few different sizes remain, so exact percentiles of them need little memory.
    sizes = counterpart_counts(rows, entity, other)
    return sizes.groupBy("size").agg(F.count("*").alias("entities"))


def interaction_metrics(rows: DataFrame, entity: str, other: str) -> DataFrame:
    """One row: number of entities; largest, median and mean number of counterparts."""
    return _size_frequencies(rows, entity, other).agg(
        F.sum("entities").alias("entities"),
        F.max("size").alias("max_size"),
        F.percentile("size", 0.5, F.col("entities")).alias("median_size"),
        (F.sum(F.col("size") * F.col("entities")) / F.sum("entities")).alias("mean_size"),
    )


def interaction_histogram(
    rows: DataFrame, entity: str, other: str, bins: int = 10
) -> DataFrame:
    """Entities per bin of equal width between the smallest and the largest size.

    The largest size belongs to the last bin; if all sizes are equal, the bins span one
    unit around them. Bins without entities are not listed.
    """
    sizes = stored(_size_frequencies(rows, entity, other), "sizes")
    smallest = sizes.agg(F.min("size")).scalar()
    largest = sizes.agg(F.max("size")).scalar()
    from_smallest = (F.col("size") - F.col("_low")) * F.lit(bins)
    place = F.floor(F.try_divide(from_smallest, F.col("_high") - F.col("_low")))
    middle = F.lit(bins // 2)
    return (
        sizes.withColumn("_low", smallest)
        .withColumn("_high", largest)
        .withColumn("bin", F.least(F.coalesce(place, middle), F.lit(bins - 1)).cast("int"))
        .groupBy("bin")
        .agg(F.sum("entities").alias("entities"))
    )


def threshold(score: Column, limit: float = 0.5) -> Column:
    return (score >= limit).cast("int")


def confusion_matrix(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """The share of each true class (0 or 1) that got each prediction, all four cells."""

    def cell(y: int, guess: int) -> Column:
        return F.count(F.when((F.col(truth) == y) & (F.col(predicted) == guess), 1))

    counts = [cell(y, guess).alias(f"n{y}{guess}") for y in (0, 1) for guess in (0, 1)]

    def entry(y: int, guess: int) -> Column:
        of_class = F.col(f"n{y}0") + F.col(f"n{y}1")
        share = F.coalesce(F.try_divide(F.col(f"n{y}{guess}"), of_class), F.lit(0.0))
        return F.struct(
            F.lit(y).alias("truth"),
            F.lit(guess).alias("predicted"),
            F.col(f"n{y}{guess}").alias("rows"),
            share.alias("share"),
        )

    cells = F.array(*[entry(y, guess) for y in (0, 1) for guess in (0, 1)])
    return rows.agg(*counts).select(F.inline(cells))


def area_under_roc(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """One row ``auc``: how often a positive scores above a negative, ties counting half.

    Rows are counted per distinct score first; the negatives below each score come from
    running sums over the sorted scores.
    """
    per_score = rows.groupBy(score).agg(
        F.count(F.when(F.col(truth) == 1, 1)).alias("positives"),
        F.count(F.when(F.col(truth) == 0, 1)).alias("negatives"),
    )
    ranked = running_sums(per_score, [score], {"below": F.col("negatives")})
    wins = F.sum(F.col("positives") * (F.col("below") + F.col("negatives") / 2.0))
    all_pairs = F.sum("positives").cast("double") * F.sum("negatives").cast("double")
    return ranked.agg(F.try_divide(wins, all_pairs).alias("auc"))
