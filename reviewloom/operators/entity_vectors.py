"""Vectors of users and businesses as sums over the words of their reviews.

The order of work keeps the wide rows few. Words are counted per review before they meet
their vectors; vectors are added up where the words of a review lie, and only these review
sums travel on to users and businesses. Vectors are read where they are and not copied. Of many,
those of the frequent words are broadcast; those of rare words, which few rows ask for, are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions import vectors as V
from reviewloom.operators.durable import (
    ROW_BYTES,
    dealt,
    joined,
    lookup,
    measured_bytes,
    released,
    stored,
    stored_lookup,
)
from reviewloom.operators.tfidf import raw_weights, weigh
from reviewloom.operators.vocabulary import code_words

ENTITIES = ("user", "business")
REVIEW_KEYS = ("user_id", "business_id", "review_id")

# The vectors of a vocabulary are broadcast up to this size; of more the most frequent, up to half of it.
VECTOR_BROADCAST_BYTES = 256 * 1024 * 1024
# More bytes of words are shuffled in turns, so many at most: every turn reads all words.
TURN_BYTES = 512 * 1024 * 1024
MOST_TURNS = 8
MOST_WEIGHT_TURNS = 3
# Rows with the vectors of rare words, of which each turn reads only its own.
WIDE_TURN_BYTES = 256 * 1024 * 1024
MOST_WIDE_TURNS = 5


def vector_sums(size: int, vector: str = "vec", times: Column | None = None) -> Column:
    """Aggregate: the vectors of the group added up, each ``times`` its number.

    One sum per component, so that partial sums are built before the shuffle.
    """
    parts = [F.get(vector, F.lit(i)) for i in range(size)]
    if times is not None:
        parts = [part * times for part in parts]
    return F.array(*[F.sum(part) for part in parts])


def _turns(number: int, most: int | None = None) -> int:
    """In how many turns, ``most`` at most, so many rows of words are shuffled."""
    return max(1, min(most or MOST_TURNS, -(-number * ROW_BYTES // TURN_BYTES)))


def _of_turn(word: str, turn: int, turns: int) -> Column:
    """Whether a word belongs to this turn of so many."""
    return F.pmod(F.xxhash64(word), F.lit(turns)) == turn


def _entity_words(counts: DataFrame, entity: str) -> DataFrame:
    """How often each entity uses each word in all its reviews (``stored``)."""
    key = f"{entity}_id"
    known = counts.where(F.col(key).isNotNull()).select(key, "word", "n")
    number = known.count()
    turns = _turns(number)

    def part(turn: int) -> DataFrame:
        mine = known.where(_of_turn("word", turn, turns))
        # Dealt first: sums ahead of the shuffle would hold nearly all rows of a task.
        own = dealt(mine, key, "word", number=-(-number // turns))
        return own.groupBy(key, "word").agg(F.sum("n").alias("tf"))

    return stored(part(0), f"{entity}-words", *map(part, range(1, turns)))


def entity_word_weights(counts: DataFrame, entity: str) -> DataFrame:
    """TF-IDF of each word for each user (or business).

    The document of an entity is all words of all its reviews; every occurrence of a word
    there has the same weight.
    """
    return weigh(_entity_words(counts, entity), f"{entity}_id")


def word_level(
    counts: DataFrame, vectors: DataFrame, entity: str, with_tfidf: bool = True
) -> DataFrame:
    """Entity, review, word, number of occurrences ``n``, ``weight`` of one, and ``vec``."""
    key = f"{entity}_id"
    rows = counts.where(F.col(key).isNotNull()).select(key, "review_id", "word", "n")
    if with_tfidf:
        weights = entity_word_weights(counts, entity).select(key, "word", "weight")
        rows = _with_pair(rows, weights, [key, "word"], rows.count())
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    vectors = stored(vectors.select("word", "vec"), "vectors")
    return joined(rows, vectors, ["word"], number=counts.count())


def _with_pair(rows: DataFrame, other: DataFrame, keys: list[str], number: int, how: str = "inner") -> DataFrame:
    """Rows of entity and word, ``number`` at most, with what is known of the pair."""
    number = 2 * number  # there are at most as many pairs as rows
    return dealt(rows, *keys, number=number).join(dealt(other, *keys, number=number), keys, how)


class _WordVectors:
    """The vectors of the words of ``counts``.

    With a vocabulary the words of ``counts`` are its indices, and those of ``vectors`` are
    spelled out; they are coded while they are read.
    """

    def __init__(self, counts: DataFrame, vectors: DataFrame, vocabulary: DataFrame | None):
        self.vectors = vectors.select("word", "vec")
        self.vocabulary = None if vocabulary is None else vocabulary.select("word", "idx")
        # Words of the same value, but of another type, would belong to another turn.
        self.type = counts.schema["word"].dataType
        self.bytes = measured_bytes(self.vectors)

    def _coded(self, rows: DataFrame) -> DataFrame:
        found = rows if self.vocabulary is None else code_words(rows, self.vocabulary)
        return found.withColumn("word", F.col("word").try_cast(self.type))

    @property
    def whole(self) -> DataFrame:
        return self._coded(self.vectors)

    def of(self, words: DataFrame) -> DataFrame:
        """The vectors of these words, a written table without repeats."""
        if self.vocabulary is None:
            return self.whole.join(lookup(words), "word", "left_semi")
        known = self.vocabulary.withColumn("idx", F.col("idx").try_cast(self.type))
        known = known.join(lookup(words.select(F.col("word").alias("idx"))), "idx", "left_semi")
        return code_words(self.vectors, known)

    def words(self) -> DataFrame:
        """A row for each vector."""
        return self._coded(self.vectors.select("word"))


@dataclass(frozen=True)
class Weighting:
    """How words count in the mean vector of an entity.

    ``with_tfidf`` off gives the plain mean. On, the sum of the plain vectors is divided
    by the sum of the weights; ``weighted_vectors`` also multiplies each vector by its
    weight, which makes it a weighted mean.
    """

    with_tfidf: bool = True
    weighted_vectors: bool = False


class ReviewSums:
    """Sums over the words of each review, and what the weights still have to be divided by.

    ``rows`` (stored): the three ids, ``user_weight``, ``business_weight``, and ``vec``;
    weighted vectors differ by side and come as ``user_vec`` and ``business_vec``.
    ``lengths`` (stored): for a side with TF-IDF weights the length of each document, or a
    function that finds it. The weights in ``rows`` are raw; the length is the same for all
    reviews of an entity, so it meets the few sums per entity instead of every wide row of a review.

    Weights need the words of all reviews of an entity. ``rows`` may be a function that finds
    them for some sides when they are asked for; ``totals`` (stored) has the sums of the entities
    without that, ``weight`` and for weighted vectors ``vec``, from the words of each entity.
    ``vectors`` (stored) are then the rows without the weights.
    """

    def __init__(
        self,
        rows: DataFrame | Callable[[Sequence[str]], DataFrame],
        lengths: dict[str, DataFrame] | Callable[[str], DataFrame],
        size: int,
        totals: Callable[[str], DataFrame] | None = None,
        vectors: DataFrame | None = None,
    ):
        self.size, self.totals, self.vectors = size, totals, vectors
        self._rows, self._lengths = rows, lengths
        self._found: dict[tuple[str, ...], DataFrame] = {}

    @property
    def rows(self) -> DataFrame:
        return self.of(ENTITIES)

    def of(self, sides: Sequence[str]) -> DataFrame:
        """``rows`` with what belongs to these sides, at least."""
        if isinstance(self._rows, DataFrame):
            return self._rows
        for known, rows in self._found.items():
            if set(sides) <= set(known):
                return rows
        return self._found.setdefault(tuple(sides), self._rows(sides))

    def lengths(self, entity: str) -> DataFrame | None:
        """The lengths of the documents of a side, None if its weights are final."""
        if isinstance(self._lengths, dict):
            return self._lengths.get(entity)
        return self._lengths(entity)


def _vector_name(rows: DataFrame, entity: str) -> str:
    return f"{entity}_vec" if f"{entity}_vec" in rows.columns else "vec"


def review_sums(
    counts: DataFrame,
    vectors: DataFrame,
    size: int,
    weighting: Weighting = Weighting(),
    vocabulary: DataFrame | None = None,
    sides: Sequence[str] = ENTITIES,
) -> ReviewSums:
    """Per review the sum of its words' vectors, and per side of their weights.

    ``vectors`` (``word``, ``vec``) is read once for each share of the words and not copied. With a
    ``vocabulary`` (``word``, ``idx``) the words of ``counts`` are its indices, those of
    ``vectors`` are not. The weights of ``sides`` are found together, when one of them is asked for.
    """
    # A review counts for each side whose id it has, whatever the other id is.
    known = counts.where(F.col("user_id").isNotNull() | F.col("business_id").isNotNull())
    known = known.select(*REVIEW_KEYS, "word", "n")
    words = _WordVectors(counts, vectors, vocabulary)
    if not weighting.with_tfidf:
        weights = {f"{entity}_weight": "n" for entity in ENTITIES}
        return ReviewSums(_vectors_of_reviews(known, words, size, "n", weights), {}, size)

    number = known.count()

    @cache
    def raw(entity: str) -> DataFrame:
        return raw_weights(_entity_words(counts, entity), f"{entity}_id")

    if weighting.weighted_vectors:
        # Weighted vectors over weights: the lengths cancel out.
        def weighted(sides: Sequence[str]) -> DataFrame:
            parts = []
            for entity in sides:
                # Brought together by review, so that the wide rows are added up where they are.
                weighed = dealt(_weighed(known, raw(entity), entity, number), *REVIEW_KEYS, number=number)
                weighed = stored(weighed, f"{entity}-weighed")
                weight = {f"{entity}_weight": "_times"}
                parts.append(_vectors_of_reviews(weighed, words, size, "_times", weight, f"{entity}_vec"))
                released(weighed)
            return _side_by_side(parts)

        def weighted_totals(entity: str) -> DataFrame:
            # A word weighs the same in all reviews of an entity, so its words can stand for them.
            key = f"{entity}_id"
            own = raw(entity).select(key, "word", (F.col("tf") * F.col("r")).alias("_times"))
            own = stored(dealt(own, key, "word", number=number), f"{entity}-weighed")
            found = _vectors_of_reviews(own, words, size, "_times", {"weight": "_times"}, keys=[key])
            released(own)
            return found

        return ReviewSums(weighted, {}, size, weighted_totals)

    found = _vectors_of_reviews(known, words, size, "n", {})

    @cache
    def weights(asked: tuple[str, ...]) -> DataFrame:
        return _weights_of_reviews(known, words, asked, number)

    def weights_of(asked: Sequence[str]) -> DataFrame:
        return weights(tuple(sides) if set(asked) <= set(sides) else tuple(asked))

    def with_weights(asked: Sequence[str]) -> DataFrame:
        own = weights_of(asked).select(*REVIEW_KEYS, *[f"{entity}_weight" for entity in asked])
        return _side_by_side([found, own], keep=[found, own])

    def of_entity(entity: str, total: Column) -> DataFrame:
        key = f"{entity}_id"
        return weights_of([entity]).where(F.col(key).isNotNull()).groupBy(key).agg(total)

    def totals(entity: str) -> DataFrame:
        return stored(of_entity(entity, F.sum(f"{entity}_weight").alias("weight")), f"{entity}-weights")

    @cache
    def lengths(entity: str) -> DataFrame:
        return stored(of_entity(entity, F.sqrt(F.sum(f"{entity}_square")).alias("length")), f"{entity}-lengths")

    return ReviewSums(with_weights, lengths, size, totals, found)


def _weighed(rows: DataFrame, raw: DataFrame, entity: str, number: int) -> DataFrame:
    """Rows of review and word with ``_times``, the number of the word times its raw weight."""
    key = f"{entity}_id"
    found = _with_pair(rows, raw.select(key, "word", "r"), [key, "word"], number, "left")
    return found.select(*REVIEW_KEYS, "word", (F.col("n") * F.col("r")).alias("_times"))


def _weights_of_reviews(rows: DataFrame, vectors: _WordVectors, sides: Sequence[str], number: int) -> DataFrame:
    """For each side the sum of the raw weights of each review, and ``square`` (``stored``).

    A word with several vectors counts as often, one without does not count. The squares of all
    reviews of an entity add up to the square of the length of its document: each row of a pair of entity
    and word has its part of it.

    All rows of a word meet in one task, where they tell its number in each entity and the number of
    entities with it; a word has one row in each review, which is a small part of all rows. The words of a
    large table are taken in several turns, by their hash.
    """
    reviews = stored(rows.select(*REVIEW_KEYS).distinct(), "reviews")
    documents = {
        entity: reviews.where(F.col(f"{entity}_id").isNotNull()).select(f"{entity}_id").distinct().count()
        for entity in sides
    }
    # A row without ids for each vector.
    marks = stored(vectors.words(), "vector-words")
    marks = marks.select(*[F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in REVIEW_KEYS], "word", F.lit(None).alias("n"))
    both = rows.withColumn("_mark", F.lit(0)).unionByName(marks.withColumn("_mark", F.lit(1)))
    turns = _turns(number, MOST_WEIGHT_TURNS)
    names = [f"{entity}_{kind}" for entity in sides for kind in ("weight", "square")]
    of_word = Window.partitionBy("word")

    def part(turn: int) -> DataFrame:
        found = dealt(both.where(_of_turn("word", turn, turns)), "word", number=-(-number // turns))
        for entity in sides:
            of_pair = Window.partitionBy("word", f"{entity}_id")
            found = found.withColumns(
                {f"_{entity}_tf": F.sum("n").over(of_pair), f"_{entity}_rows": F.count("*").over(of_pair)}
            )
        # A pair of word and entity counts once, however many rows it has.
        once = {entity: F.when(F.col(f"{entity}_id").isNotNull(), 1.0 / F.col(f"_{entity}_rows")) for entity in sides}
        found = found.withColumns(
            {f"_{entity}_df": F.round(F.sum(once[entity]).over(of_word)) for entity in sides}
            | {"_vectors": F.sum("_mark").over(of_word)}
        ).where(F.col("_mark") == 0)
        times = F.when(F.col("_vectors") > 0, F.col("n") * F.col("_vectors"))
        sums = []
        for entity in sides:
            idf = F.log((F.lit(1.0) + documents[entity]) / (F.lit(1.0) + F.col(f"_{entity}_df"))) + F.lit(1.0)
            raw = F.when(F.col(f"{entity}_id").isNotNull(), F.col(f"_{entity}_tf") * idf)
            found = found.withColumn(f"_{entity}_raw", raw)
            own = F.col(f"_{entity}_raw")
            sums += [F.sum(times * own), F.sum(own * own * once[entity])]
        return found.groupBy(*REVIEW_KEYS).agg(*[total.alias(name) for name, total in zip(names, sums, strict=True)])

    parts = stored(part(0), "review-weights", *[part(turn) for turn in range(1, turns)])
    if turns == 1:
        return parts
    found = stored(parts.groupBy(*REVIEW_KEYS).agg(*[F.sum(name).alias(name) for name in names]), "review-weights")
    released(parts)
    return found


def _frequent_words(rows: DataFrame, room: float) -> tuple[DataFrame, int, int]:
    """The words of the rows with their number ``_n`` (``stored``), from which number on at most ``room``
    words are frequent, and how many rows have others."""
    numbers = stored(rows.groupBy("word").agg(F.count("*").alias("_n")), "word-numbers")
    # At most one row for each power of two.
    power = (F.length(F.bin("_n")) - 1).alias("power")
    sizes = numbers.groupBy(power).agg(F.count("*").alias("words"), F.sum("_n").alias("rows")).collect()
    least, rest = 1 << 62, 0
    for size in sorted(sizes, reverse=True):
        room -= size["words"]
        if room < 0:
            rest += size["rows"]
        else:
            least = 1 << size["power"]
    return numbers, least, rest


def _vectors_of_reviews(
    rows: DataFrame,
    vectors: _WordVectors,
    size: int,
    times: str,
    weights: Mapping[str, str],
    name: str = "vec",
    keys: Sequence[str] = REVIEW_KEYS,
) -> DataFrame:
    """Per review (or other ``keys``) the sum ``name`` of its words' vectors, each ``times`` that
    column, and the sums ``weights`` of other columns (``stored``).

    The words of a review lie together, so that its vectors are added up in place. Of vectors beyond
    a broadcast those of the most frequent words are; they belong to most rows. Rows of rare words
    meet their vectors in a shuffle, on large tables in several turns, and are put to the sums so far.
    """

    def wide(part: DataFrame) -> DataFrame:
        return part.select(
            *keys,
            *[F.col(column).cast("double").alias(weight) for weight, column in weights.items()],
            F.col(times).cast("double").alias("_number"),
            "vec",
        )

    def added(part: DataFrame) -> DataFrame:
        total = vector_sums(size, times=F.col("_number")).alias(name)
        return stored(part.groupBy(*keys).agg(*[F.sum(w).alias(w) for w in weights], total), "vector-part")

    if vectors.bytes <= VECTOR_BROADCAST_BYTES:
        return added(wide(rows.join(F.broadcast(vectors.whole), "word")))
    number = max(1, vectors.vectors.count())
    width = vectors.bytes / number
    numbers, least, rest = _frequent_words(rows, VECTOR_BROADCAST_BYTES / 2 / (width + 32))
    frequent = stored(numbers.where(F.col("_n") >= least).select("word"), "frequent-words")
    others = stored(numbers.where(F.col("_n") < least).select("word"), "rare-words")
    found = added(wide(rows.join(F.broadcast(vectors.of(frequent)), "word")))
    if not rest:
        return found
    rare = stored(rows.join(F.broadcast(frequent), "word", "left_anti"), "rare-rows")
    # In rows of ROW_BYTES, which ``dealt`` counts in.
    in_rows, words = math.ceil(rest * width / ROW_BYTES), math.ceil(others.count() * width / ROW_BYTES)
    turns = max(1, min(MOST_WIDE_TURNS, -(-(in_rows + words) * ROW_BYTES // min(WIDE_TURN_BYTES, TURN_BYTES))))
    sums = math.ceil(found.count() * 8 * size / ROW_BYTES)
    for turn in range(turns):
        mine = dealt(rare.where(_of_turn("word", turn, turns)), "word", number=(rest + words) // turns + 1)
        own = vectors.of(others.where(_of_turn("word", turn, turns)))
        own = dealt(own, "word", number=(rest + words) // turns + 1)
        so_far = found.withColumn("_number", F.lit(1.0)).withColumnRenamed(name, "vec")
        part = wide(mine.join(own, "word")).unionByName(so_far)
        # Dealt first: sums ahead of the shuffle would hold nearly all rows of a task.
        before, found = found, added(dealt(part, *keys, number=in_rows // turns + 1 + sums))
        released(before)
    released(rare)
    return found


def _side_by_side(parts: Sequence[DataFrame], keep: Sequence[DataFrame] = ()) -> DataFrame:
    """Tables with one row per review as one (``stored``). The tables go, but for those to ``keep``."""
    if len(parts) == 1:
        return parts[0]
    found = stored(reduce(_same_row, parts), "review-sums")
    released(*[part for part in parts if part not in keep])
    return found


def _same_row(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Two tables (``stored``) with one row per review, side by side; ids may be null."""
    names = {key: f"_{key}" for key in REVIEW_KEYS}
    renamed = lookup(other.withColumnsRenamed(names))
    same = [F.col(key).eqNullSafe(F.col(own)) for key, own in names.items()]
    return rows.join(renamed, same).drop(*names.values())


def entity_sums(sums: ReviewSums, entity: str) -> DataFrame:
    """Per user (or business) ``vec`` and ``weight`` over its ``reviews``.

    ``length`` is what the weight of each single review still has to be divided by.
    """
    key = f"{entity}_id"
    rows = sums.of([entity]) if sums.vectors is None else sums.vectors
    weights = [] if sums.vectors is not None else [F.sum(f"{entity}_weight").alias("weight")]
    totals = rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        vector_sums(sums.size, _vector_name(rows, entity)).alias("vec"),
        *weights,
        F.count("*").alias("reviews"),
    )
    if sums.vectors is not None:
        totals = totals.join(sums.totals(entity), key)
    lengths = sums.lengths(entity)
    if lengths is None:
        return totals.withColumn("length", F.lit(1.0))
    return totals.join(lengths, key).withColumn("weight", F.col("weight") / F.col("length"))


def entity_means(sums: ReviewSums, entity: str) -> DataFrame:
    """Per user (or business) the mean vector over all its reviews."""
    mean = V.divide(F.col("vec"), F.col("weight")).alias(f"{entity}_vec")
    whole = sums.totals is not None and sums.vectors is None
    found = sums.totals(entity) if whole else entity_sums(sums, entity)
    return found.select(f"{entity}_id", mean)


def leave_one_out(sums: ReviewSums, sides: Sequence[str] = ENTITIES) -> DataFrame:
    """Per review the mean vectors of its user and its business without that review.

    Reviews whose user or business has no other review are dropped, by the number of
    reviews rather than by a difference of sums that may leave a rounding error.
    """
    rows = sums.of(sides).where(F.col("user_id").isNotNull() & F.col("business_id").isNotNull())
    for entity in sides:
        key = f"{entity}_id"
        totals = (
            entity_sums(sums, entity)
            .where(F.col("reviews") > 1)
            .select(
                key,
                F.col("vec").alias("_all"),
                F.col("weight").alias("_all_weight"),
                F.col("length").alias("_length"),
            )
        )
        other_weight = F.col("_all_weight") - F.col(f"{entity}_weight") / F.col("_length")
        others = F.zip_with(
            "_all", _vector_name(sums.of(sides), entity), lambda x, own: F.try_divide(x - own, F.col("_rest"))
        )
        rows = (
            rows.join(stored_lookup(totals, f"{entity}-totals"), key)
            .withColumn("_rest", other_weight)
            .withColumn(f"{entity}_vec", others)
            .drop("_all", "_all_weight", "_length", "_rest", f"{entity}_weight")
        )
    return rows.select(*REVIEW_KEYS, *[f"{entity}_vec" for entity in sides])
