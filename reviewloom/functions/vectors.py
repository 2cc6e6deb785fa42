"""Expressions on vectors held as ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def split_vector(vector: Column, size: int, prefix: str = "v") -> list[Column]:
    """One column per component: ``v0``, ``v1`` and so on."""
    return [F.get(vector, F.lit(i)).alias(f"{prefix}{i}") for i in range(size)]


def gather_vector(size: int, prefix: str = "v") -> Column:
    """The inverse of :func:`split_vector`."""
    return F.array(*[F.col(f"{prefix}{i}") for i in range(size)])


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def length(vector: Column) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x)
    return F.sqrt(squares)


def _for_each(vector: Column, number: Column) -> Column:
    # A column named inside a lambda is computed again for every element; as an argument
    # of its own it is computed once per row.
    return F.array_repeat(number, F.size(vector))


def divide(vector: Column, number: Column) -> Column:
    """Every component divided by the number; null components when the number is 0."""
    return F.zip_with(vector, _for_each(vector, number), F.try_divide)


def scale(vector: Column, number: Column) -> Column:
    return F.zip_with(vector, _for_each(vector, number), lambda x, y: x * y)


def unit(vector: Column) -> Column:
    """The vector divided by its length; null components for the zero vector."""
    return divide(vector, length(vector))


def pair_concat(user_vector: Column, business_vector: Column) -> Column:
    return F.concat(user_vector, business_vector)


def pair_product(user_vector: Column, business_vector: Column) -> Column:
    return F.zip_with(unit(user_vector), unit(business_vector), lambda x, y: x * y)


def zero_if_not_finite(number: Column) -> Column:
    """Null, NaN and both infinities become 0."""
    infinite = F.abs(number) == F.lit(float("inf"))
    return F.when(number.isNull() | F.isnan(number) | infinite, 0.0).otherwise(number)
