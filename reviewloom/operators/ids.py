"""Dense integer ids for values and for rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.durable import lookup
from reviewloom.operators.ordering import numbered


def label_codes(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    """The distinct values of a column with their place 0..n-1 in ascending order."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return numbered(values, [column], code)


def encode_labels(df: DataFrame, *columns: str) -> DataFrame:
    """Replace the values of each column by their codes; null stays null."""
    for column in columns:
        codes = label_codes(df, column, f"{column}_code")
        df = (
            df.join(lookup(codes), column, "left")
            .withColumn(column, F.col(f"{column}_code"))
            .drop(f"{column}_code")
        )
    return df


def add_review_ids(
    reviews: DataFrame, start: int = 0, order_by: Sequence[str] = ()
) -> DataFrame:
    """Number the rows from ``start`` on, as they are read.

    Texts are written once and neither sorted nor shuffled. With ``order_by`` the rows are
    sorted by these columns first, so that the numbers do not depend on the files.
    """
    return numbered(reviews, order_by, "review_id", start)


def split_ids_and_text(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The id table and the text table of numbered reviews."""
    ids = reviews.select("user_id", "business_id", "review_id")
    return ids, reviews.select("review_id", "review_text")
