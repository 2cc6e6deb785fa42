"""Unseen pairs as negatives, the labelled training set, and its exact split."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators.durable import lookup, stored, stored_lookup
from reviewloom.operators.ordering import numbered, preceding, running_sums

PAIR = ("user_id", "business_id")


def spread_hash(number: Column, salt: str) -> Column:
    """A number of 48 bits from the md5 of ``number:salt``, the same in every engine."""
    digest = F.md5(F.concat(number.cast("string"), F.lit(f":{salt}")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def fast_hash(number: Column, salt: str) -> Column:
    """A number of 48 bits from Spark's own hash, much cheaper than :func:`spread_hash`."""
    return F.shiftrightunsigned(F.xxhash64(number, F.lit(salt)), 16)


Hash = Callable[[Column, str], Column]


def unseen_pairs(
    seen: DataFrame, hashed: Hash = fast_hash, none_left: bool = False
) -> DataFrame:
    """As many random pairs that nobody has seen as there are seen rows with both ids.

    ``candidate`` (from 0 on), ``user_id``, ``business_id``. A pair comes up with the chance
    it has when user and business are drawn independently from the rows and seen pairs
    are thrown away, so frequent ones come up more often, and a pair may repeat. Nothing
    is thrown away here, however few pairs are left:

    All businesses lie on a line, each on a stretch as long as its number of rows. What a
    user has seen cuts this line into gaps. The gaps of all users, each as many times as
    the user has rows, form a second line. A draw is a point on it: the gap it falls in
    gives the user, and its place within the gap the business.

    The rows of the second line are at most the seen pairs and the users. Both lines are
    sums over a global order, so that a user or a business with a large part of all rows is
    dealt over many tasks. The draws do not depend on the partitions. Rows without one of the
    ids take no part; if no pair is left, it is an error, or, with ``none_left``, there are no
    rows.
    """
    rows = seen.where(F.col("user_id").isNotNull() & F.col("business_id").isNotNull()).select(*PAIR)
    pairs = stored(rows.groupBy(*PAIR).agg(F.count("*").alias("n")), "known")
    count = pairs.agg(F.sum("n")).first()[0] or 0
    nothing = rows.select(F.lit(0).cast("bigint").alias("candidate"), *PAIR).where(F.lit(False))
    if count == 0:
        return nothing
    businesses = _popularity_line(pairs)
    gaps = stored(_gaps(pairs, businesses, count), "gaps")
    found = gaps.agg(F.sum("weight").alias("whole"), F.count("*").alias("n")).first()
    if not found["n"] and none_left:
        return nothing
    if not found["n"]:
        raise ValueError("every user has seen every business: there is no unseen pair")
    line = running_sums(gaps, ["user_id", "free_from"], {"first": F.col("weight")})
    line = line.withColumn("end", F.col("first") + F.col("weight")).drop("weight")
    # Two hashes of 48 bits, so that points lie close enough together on a long line.
    high, low = (hashed(F.col("id"), salt).cast("decimal(15,0)") for salt in ("u", "b"))
    point = (high * F.lit(1 << 48).cast("decimal(15,0)") + low) % F.lit(found["whole"])
    points = seen.sparkSession.range(count).select(
        F.col("id").alias("candidate"), point.cast(_LENGTH).alias("point")
    )
    met = _stretch_of(points, line, int(found["whole"]), count // _IN_BUCKET + 1, "gap-line")
    inside = F.expr("cast((point - first) div user_n as bigint)")
    placed = met.select("candidate", "user_id", (F.col("free_from") + inside).cast(_LENGTH).alias("point"))
    return _stretch_of(placed, businesses, count, count // _IN_BUCKET + 1, "business-line").select(
        "candidate", *PAIR
    )


# Lengths of lines over pairs are products of two numbers of rows.
_LENGTH = "decimal(38,0)"
# Points and stretches meet in buckets of about so many points.
_IN_BUCKET = 4
_CHUNK = 1 << 16


def _popularity_line(pairs: DataFrame) -> DataFrame:
    """Each business with ``first`` and ``end`` of its stretch of the line (``stored``)."""
    counts = pairs.groupBy("business_id").agg(F.sum("n").alias("n"))
    line = running_sums(counts, ["business_id"], {"first": F.col("n")})
    return stored(
        line.select("business_id", F.col("first"), (F.col("first") + F.col("n")).alias("end")), "businesses"
    )


def _gaps(pairs: DataFrame, businesses: DataFrame, length: int) -> DataFrame:
    """What each user has not seen of the line of businesses, as stretches without seen ones.

    ``free_from`` on that line, ``user_n`` rows of the user, and ``weight``, the length of the
    gap times ``user_n``. Gaps are found between neighbours in one order of all seen
    stretches, in which a mark closes the line of each user.
    """
    users = stored_lookup(pairs.groupBy("user_id").agg(F.sum("n").alias("user_n")), "user-rows")
    known = pairs.join(lookup(businesses), "business_id").select("user_id", "first", "end")
    end = F.lit(length).cast("bigint")
    marks = users.select("user_id", end.alias("first"), end.alias("end"))
    ordered = preceding(
        known.unionByName(marks), ["user_id", "first"], {"_user": F.col("user_id"), "_end": F.col("end")}
    )
    free = F.when(F.col("_user") == F.col("user_id"), F.col("_end")).otherwise(F.lit(0).cast("bigint"))
    open_ones = ordered.withColumn("free_from", free).where(F.col("free_from") < F.col("first"))
    weight = (F.col("first") - F.col("free_from")).cast("decimal(19,0)") * F.col("user_n").cast("decimal(18,0)")
    return open_ones.join(users, "user_id").select(
        "user_id", "free_from", "user_n", weight.cast(_LENGTH).alias("weight")
    )


def _each_number(df: DataFrame, name: str, first: Column, last: Column) -> DataFrame:
    """A row for each whole number from ``first`` to ``last``, listed in chunks."""
    chunks = df.withColumn("_from", F.explode(F.sequence(first, last, F.lit(_CHUNK).cast("bigint"))))
    numbers = F.sequence(F.col("_from"), F.least(last, F.col("_from") + (_CHUNK - 1)))
    return chunks.withColumn(name, F.explode(numbers)).drop("_from")


def _stretch_of(points: DataFrame, line: DataFrame, length: int, buckets: int, label: str) -> DataFrame:
    """Each ``point`` with the columns of the stretch from ``first`` to before ``end`` that holds it.

    Points and stretches meet by equal buckets of the line; a long stretch lies in many of
    them, so no stretch is a hot key, and all of them together make at most as many rows as
    there are buckets more.
    """
    width = f"cast('{length // buckets + 1}' as {_LENGTH})"

    def bucket(place: str) -> Column:
        return F.expr(f"cast(cast({place} as {_LENGTH}) div {width} as bigint)")

    # Written, so that Spark knows the size and deals the points by bucket where the line is long.
    dealt = stored(_each_number(line, "_bucket", bucket("first"), bucket("end - 1")), label)
    inside = (F.col("first") <= F.col("point")) & (F.col("point") < F.col("end"))
    return points.withColumn("_bucket", bucket("point")).join(dealt, "_bucket").where(inside).drop("_bucket")


def attach_vectors(pairs: DataFrame, users: DataFrame, businesses: DataFrame) -> DataFrame:
    """Pairs with the mean vectors of their user and their business."""
    return pairs.join(users, "user_id").join(businesses, "business_id")


def labelled(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Positives with ``y`` 1 and negatives with ``y`` 0, as one table."""
    return positives.withColumn("y", F.lit(1)).unionByName(
        negatives.withColumn("y", F.lit(0))
    )


# Hash values are counted in this many equal ranges before the exact cut is looked for.
_RANGES = 1 << 16
_RANGE_BITS = 32


def _held_out_sizes(rows: DataFrame, label: str, share: float) -> DataFrame:
    """``_class`` and how many of its rows are held out, ``_wanted``; in total the share, rounded up.

    Each class gets its part rounded down, and the rows still missing go to the classes
    with the largest remainders; among equals the null class comes last.
    """
    sizes = stored(rows.groupBy("_class", label).agg(F.count("*").alias("_n")), "class-sizes")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    wanted = math.ceil(round(total * share, 9))
    exact = F.lit(float(wanted)) * F.col("_n") / F.lit(float(max(total, 1)))
    parts = sizes.withColumn("_whole", F.floor(exact)).withColumn("_below", F.floor(exact) - exact)
    missing = wanted - (parts.agg(F.sum("_whole")).first()[0] or 0)
    placed = numbered(parts, ["_below", F.col(label).isNull(), label], "_place")
    return placed.select("_class", (F.col("_whole") + (F.col("_place") < missing).cast("int")).alias("_wanted"))


def stratified_split(
    rows: DataFrame, label: str, key: str, share: float = 0.25, hashed: Hash = fast_hash
) -> DataFrame:
    """Add ``held_out``: an exact share of each class, chosen by a hash of the key.

    A class may be half of all rows, so it is neither sorted nor numbered. The rows are
    counted per range of the hash; the range in which the share is reached is the only
    one whose rows are put in order, which yields the last held-out row of the class.
    Every row is then compared with that one.
    """
    # Null is a class like any other, so the joins go by a name that is never null.
    named = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null"))
    marked = rows.withColumn("_hash", hashed(F.col(key), "split")).withColumn("_class", named)
    keys = marked.select(label, "_class", key, "_hash").withColumn(
        "_range", F.shiftright("_hash", _RANGE_BITS)
    )
    wanted = stored_lookup(_held_out_sizes(keys.select("_class", label), label, share), "quotas")
    before = Window.partitionBy("_class").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # At most _RANGES rows per class.
    ranges = (
        keys.groupBy("_class", "_range")
        .agg(F.count("*").alias("_n"))
        .join(wanted, "_class")
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_missing", F.col("_wanted") - F.col("_before"))
        .where((F.col("_missing") > 0) & (F.col("_missing") <= F.col("_n")))
        .select("_class", "_range", "_missing")
    )
    in_range = Window.partitionBy("_class").orderBy("_hash", key)
    # One row per class.
    last = (
        keys.join(stored_lookup(ranges, "cut-ranges"), ["_class", "_range"])
        .withColumn("_place", F.row_number().over(in_range))
        .where(F.col("_place") == F.col("_missing"))
        .select("_class", F.struct("_hash", F.col(key).alias("_key")).alias("_last"))
    )
    own = F.struct("_hash", F.col(key).alias("_key"))
    return (
        marked.join(stored_lookup(last, "last-held-out"), "_class", "left")
        .withColumn("held_out", F.coalesce(own <= F.col("_last"), F.lit(False)))
        .drop("_hash", "_last", "_class")
    )
