"""Mixing sources to target weights by repeating documents.

Words are added up per source, targets become repetition rates, and every document is given
out ``floor(rate)`` times and once more with the probability of the remaining fraction. The
draw is a hash of the document and a seed, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import n_words, same, text_of
from reviewloom.operators.durable import stored, stored_lookup

WEIGHTS = (5.0, 2.0, 1.0)
_DIGITS = 13  # hexadecimal digits of a draw: 52 bits, exact in a double


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """One row per source (null is one): ``source_size``, ``target``, ``rate``.

    Sources in the order of their code points, null last, take the weights in turn and share
    ``share`` times all words. A target stops at ``most`` times its source's size and the
    excess goes to the others by weight, until none is above. In the order of the size for
    the weight the stopped sources come first, so running sums over the sources find the
    level at once. The table has one row per source; no document is in these windows.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    ranked = totals.withColumn("weight", weight).withColumn(
        "ratio", F.col("source_size") * F.lit(float(most)) / F.col("weight")
    )
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    stopped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(most))
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - stopped
    # What the rest would get per weight if the sources before stopped. It rises while they
    # do have to stop and falls from then on, so the level that holds is the highest.
    levels = ranked.withColumn("level", left / F.sum("weight").over(after))
    level = F.max("level").over(everything)
    capped = F.col("source_size") * F.lit(float(most))
    done = levels.withColumn("target", F.least(capped, level * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return done.select("source", "source_size", "target", rate.alias("rate"))


def copies(rate: Column, name: Column, seed: int) -> Column:
    """``floor(rate)``, and one more with the probability of the fraction."""
    word = F.md5(F.concat_ws(":", F.lit(str(seed)), name))
    draw = F.conv(F.substring(word, 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))
    return F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)


def _repeated(docs: DataFrame, key: str) -> DataFrame:
    """``_key`` of the keys that several rows share, as text."""
    keys = docs.select(F.col(key).cast("string").alias("_key")).where(F.col("_key").isNotNull())
    shared = keys.groupBy("_key").count().where("count > 1").select("_key", F.lit(True).alias("_shared"))
    return stored_lookup(shared, "shared-keys")


def _named(docs: DataFrame, key: Column, text: Column, repeated: DataFrame) -> DataFrame:
    """Add ``_name``, what the draw of a row hashes: its key; where rows share the key or have
    none, also the text and the place of the row, so that no group is drawn as one."""
    own = docs.withColumn("_name", F.coalesce(key.cast("string"), F.lit("")))
    place = F.concat_ws(":", "_name", F.xxhash64(text).cast("string"), F.monotonically_increasing_id().cast("string"))
    own = own.withColumn("_alone", key.isNull()).withColumn("_place", place)
    joined = own.join(repeated, F.col("_name") == F.col("_key"), "left")
    many = F.col("_alone") | F.col("_shared").isNotNull()
    return joined.withColumn("_name", F.when(many, F.col("_place")).otherwise(F.col("_name")))


def mix_plan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """One row per document: ``key``, size, source_size, target, copies.

    The size of a document is its number of words; a null text has none. Edges: null is a
    source of its own, the last by name; a source without words gets no copies; rows without
    a key or with a repeated one draw by their text and place as well, each for itself (reruns
    over the same files agree); an empty table gives no rows.
    """
    named = docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    named = _named(named, F.col("id"), F.col("text"), _repeated(docs, key))
    sizes = named.select("id", "source", n_words(text_of("text")).alias("size"), "_name")
    # Read twice, but without the texts: for the totals, and for the documents.
    sizes = stored(sizes, "sizes")
    targets = stored(source_targets(sizes, weights, share, most), "targets")
    targets = targets.withColumnRenamed("source", "_source")
    return sizes.join(targets, same(F.col("source"), F.col("_source")), "left").select(
        F.col("id").alias(key),
        "size",
        "source_size",
        "target",
        copies(F.col("rate"), F.col("_name"), seed).cast("bigint").alias("copies"),
    )


def mixed(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """The documents themselves, each as often as :func:`mix_plan` says."""
    sizes = docs.select(F.col(source).cast("string").alias("source"), n_words(text_of(F.col(text))).alias("size"))
    targets = stored(source_targets(sizes, weights, share, most), "targets")
    targets = targets.select(F.col("source").alias("_source"), F.col("rate").alias("_rate"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    packed = docs.select(
        row, F.col(key).alias("_id"), F.col(source).cast("string").alias("_own"), F.col(text).alias("_text")
    )
    packed = _named(packed, F.col("_id"), F.col("_text"), _repeated(docs, key))
    rated = packed.join(targets, same(F.col("_own"), F.col("_source")), "left")
    number = copies(F.col("_rate"), F.col("_name"), seed).cast("int")
    return rated.select("row", F.explode(F.array_repeat(F.lit(1), number))).select("row.*")
