"""From reviews, a vocabulary and word vectors to everything a classifier needs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.fixed_values import STOP_WORDS
from reviewloom.functions.vectors import pair_concat, pair_product
from reviewloom.operators.durable import released, stored
from reviewloom.operators.entity_vectors import (
    Weighting,
    entity_means,
    leave_one_out,
    review_sums,
)
from reviewloom.operators.sampling import (
    Hash,
    attach_vectors,
    fast_hash,
    labelled,
    unseen_pairs,
)
from reviewloom.operators.vocabulary import usable_words
from reviewloom.operators.words import (
    coded_review_words,
    drop_double_singletons,
    one_row_per_word,
    review_pairs,
)


@dataclass(frozen=True)
class Settings:
    """``concatenated``: pair features are both vectors, else their product.

    ``hashed`` draws the unseen pairs; ``spread_hash`` draws the same ones in every engine.
    """

    vector_size: int
    weighting: Weighting = field(default_factory=Weighting)
    concatenated: bool = True
    stop_words: Iterable[str] = STOP_WORDS
    hashed: Hash = fast_hash


def kept_word_counts(
    reviews: DataFrame,
    vocabulary: DataFrame,
    vectors: DataFrame,
    stop_words: Iterable[str] = STOP_WORDS,
) -> DataFrame:
    """Word counts of the reviews that stay after both clean-up steps.

    ``word`` is the word's index in the vocabulary. Reviews without a usable word have no
    row here. The text is read and cut into words once; all later steps start from the
    written counts.
    """
    usable = usable_words(vocabulary.select("word", "idx"), vectors, stop_words)
    texts = reviews.select("user_id", "business_id", "review_id", "review_text")
    words = coded_review_words(texts, stored(usable, "usable"))
    counts = stored(one_row_per_word(texts, words), "counts")
    released(words)
    return drop_double_singletons(counts, review_pairs(counts))


@dataclass(frozen=True)
class Prepared:
    """``seen`` are reviews with leave-one-out vectors, ``unseen`` are sampled pairs.

    The words of ``counts`` are indices of the vocabulary.
    """

    counts: DataFrame
    seen: DataFrame
    unseen: DataFrame
    users: DataFrame
    businesses: DataFrame


def prepare(
    reviews: DataFrame, vocabulary: DataFrame, vectors: DataFrame, settings: Settings
) -> Prepared:
    """The whole preparation.

    ``vocabulary`` (``word``, ``idx``) and ``vectors`` (``word``, ``vec``) are tables that can be
    read again and again.
    Where every user has seen every business, ``unseen`` has no rows.
    """
    size = settings.vector_size
    counts = kept_word_counts(reviews, vocabulary, vectors, settings.stop_words)
    sums = review_sums(counts, vectors, size, settings.weighting, vocabulary)
    users = stored(entity_means(sums, "user"), "users")
    businesses = stored(entity_means(sums, "business"), "businesses")
    seen = stored(leave_one_out(sums), "pairs")
    drawn = unseen_pairs(seen, hashed=settings.hashed, none_left=True)
    unseen = attach_vectors(drawn, users, businesses)
    return Prepared(counts, seen, unseen, users, businesses)


def pair_features(concatenated: bool) -> Column:
    """The feature vector of a pair from ``user_vec`` and ``business_vec``."""
    conjoin = pair_concat if concatenated else pair_product
    return conjoin(F.col("user_vec"), F.col("business_vec"))


def training_set(prepared: Prepared, concatenated: bool = True) -> DataFrame:
    """``key``, the pair, its features ``x``, and ``y`` (1 seen, 0 unseen)."""

    def rows(pairs: DataFrame, number: str, mark: str) -> DataFrame:
        key = F.concat(F.lit(mark), F.col(number).cast("string")).alias("key")
        return pairs.select(
            key, "user_id", "business_id", pair_features(concatenated).alias("x")
        )

    return labelled(
        rows(prepared.seen, "review_id", "s"), rows(prepared.unseen, "candidate", "u")
    )
