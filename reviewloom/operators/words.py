"""From reviews to words, and the clean-up of reviews that cannot be learned from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.text import clean_text, counted, split_on_blank
from reviewloom.operators.durable import lookup, stored, stored_lookup, with_entries


def all_words(reviews: DataFrame, text: str = "review_text") -> DataFrame:
    """One row per token of the cleaned text, as ``word``; the other columns stay."""
    others = [name for name in reviews.columns if name != text]
    tokens = split_on_blank(clean_text(F.col(text)))
    return reviews.select(*others, F.explode(tokens).alias("word"))


def counted_words(reviews: DataFrame, text: str = "review_text") -> DataFrame:
    """One row per row and different token of its cleaned text: ``word`` and its number ``n``.

    Tokens are counted within the row, so no task holds more of them than one text has.
    """
    others = [name for name in reviews.columns if name != text]
    tokens = split_on_blank(clean_text(F.col(text)))
    return reviews.select(*others, F.inline(counted(tokens)))


def review_words(reviews: DataFrame, usable: DataFrame, by_word: bool = False) -> DataFrame:
    """One row per occurrence of a usable word, or ``by_word`` one with their number ``n``."""
    words = stored(counted_words(reviews), "words")
    known = stored(usable.select("word").distinct(), "usable")
    found = with_entries(words, known, "word")
    if by_word:
        return found
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("_time")
    return found.select("*", times).drop("n", "_time")


def coded_review_words(reviews: DataFrame, usable: DataFrame) -> DataFrame:
    """Usable words per review with their number ``n`` and their index as ``word``: shorter
    rows and keys from here on.

    ``usable`` (``word``, ``idx``) is a stored table.
    """
    codes = usable.select("word", F.col("idx").alias("_code"))
    found = with_entries(stored(counted_words(reviews), "words"), codes, "word")
    return found.withColumn("word", F.col("_code")).drop("_code")


def review_word_counts(words: DataFrame) -> DataFrame:
    """How often (``n``) each word occurs in each review; a row stands for its own ``n`` if it has one.

    Rows are dealt by review and word before they are counted: they hardly repeat, so that
    sums ahead of the shuffle would only fill the memory of the tasks.
    """
    keys = ["user_id", "business_id", "review_id", "word"]
    number = F.sum("n") if "n" in words.columns else F.count("*")
    return words.repartition(*keys).groupBy(*keys).agg(number.alias("n"))


def one_row_per_word(reviews: DataFrame, words: DataFrame) -> DataFrame:
    """The counted words of the reviews, those of repeated reviews added up.

    The words of a review stay together where its text was cut; only those of reviews that
    have several rows are shuffled.
    """
    keys = ["user_id", "business_id", "review_id"]
    words = words.select(*keys, "word", "n")
    times = reviews.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    names = {key: f"_{key}" for key in keys}
    repeated = stored(times.drop("rows").withColumnsRenamed(names), "repeated")
    if repeated.isEmpty():
        return words
    same = [F.col(key).eqNullSafe(F.col(own)) for key, own in names.items()]
    marked = words.join(lookup(repeated.withColumn("_again", F.lit(True))), same, "left")
    single = marked.where(F.col("_again").isNull()).drop(*names.values(), "_again")
    several = marked.where(F.col("_again")).drop(*names.values(), "_again")
    return single.unionByName(review_word_counts(several).repartition(*keys))


def attach_ids(ids: DataFrame, words: DataFrame) -> DataFrame:
    """The words of each review with the ids of its user and business."""
    return ids.join(words, "review_id")


def reviews_with_words(reviews: DataFrame, words: DataFrame) -> DataFrame:
    """The reviews, or review ids, that still have a word."""
    return reviews.join(words.select("review_id").distinct(), "review_id", "left_semi")


def values_seen_once(ids: DataFrame, column: str) -> DataFrame:
    """The values of a column that occur in exactly one row, with that row's review."""
    return (
        ids.groupBy(column)
        .agg(F.count("*").alias("rows"), F.min("review_id").alias("review_id"))
        .where(F.col("rows") == 1)
        .drop("rows")
    )


def double_singletons(ids: DataFrame) -> DataFrame:
    """The reviews that are the only one of their user and the only one of their business.

    ``ids`` has one row per review. A value seen once names its single review, so the two
    lists meet on the review id, which no hot user or business can skew.
    """
    lone_user = values_seen_once(ids, "user_id").select("review_id")
    lone_business = values_seen_once(ids, "business_id").select("review_id")
    return lone_user.join(lone_business, "review_id", "left_semi")


def drop_double_singletons(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The rows of all reviews but the double singletons, as ``ids`` has them."""
    lone = stored_lookup(double_singletons(rows if ids is None else ids), "lone")
    return rows.join(lone, "review_id", "left_anti")


def review_pairs(words: DataFrame) -> DataFrame:
    """The distinct user, business and review."""
    return words.select("user_id", "business_id", "review_id").distinct()
