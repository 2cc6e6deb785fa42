"""Near-copies by word shingles: MinHash bands propose pairs, exact sets of shingles decide.

A pair of Jaccard similarity ``j`` meets in a band of ``DEPTH`` minima with chance
``j ** DEPTH``; with ``BANDS`` independent bands 0.07 % of the pairs at 0.8 meet in none, and
fewer above. In each band members of a bucket are compared with representatives of it, which
leave it then; buckets whose members are all of one component are done. From the second round
on a bucket with few members outside its largest component ends at once: each of them is
compared with all. So no pair of a bucket is left out, and a large group of copies costs about
one comparison per member.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import by_batch, text_of
from reviewloom.llm.components import components
from reviewloom.operators.durable import stored

WIDTH, LEAST, SEED = 5, 0.8, 42
BANDS, DEPTH = 24, 6
# Representatives of a bucket grow by this factor from round to round, at least.
GROWTH = 64
# A bucket with so many members outside its largest component ends in the next round.
FEW = 64
_PART = 2048

_draw = np.random.default_rng(SEED)
_TIMES = _draw.integers(0, 1 << 63, BANDS * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, BANDS * DEPTH, np.uint64)


def words_of(text: str) -> list[bytes]:
    # Splitting bytes parts words at exactly space and the control characters 9 to 13.
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of all runs of five words; a shorter text is one run."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    width = min(WIDTH, len(words))
    ends = np.cumsum([len(word) + 1 for word in words])
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """One signed number per band, equal where all minima of the band are; no words: none."""
    if not len(hashes):
        return []
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _PART):
        mixed = hashes[None, at : at + _PART] * _TIMES[:, None]
        mixed += _PLUS[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    digest = xxhash.xxh64_intdigest
    found = [digest(least[b * DEPTH : (b + 1) * DEPTH].tobytes(), b) for b in range(BANDS)]
    return np.array(found, np.uint64).view(np.int64).tolist()


def similar(left: bytes, right: bytes) -> bool:
    a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return shared >= LEAST * (len(a) + len(b) - shared) - 1e-9


def _signatures(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``row``, ``point`` (equal for equal words), ``size`` (distinct shingles) and ``bands``."""
    some = rows.select(F.col(key).alias("row"), text_of(F.col(text)).alias("text"))

    def function(batch: dict[str, list]) -> dict[str, list]:
        words = [words_of(x) for x in batch["text"]]
        points = [xxhash.xxh64_intdigest(b" ".join(x), SEED + 1) for x in words]
        points = np.array(points, np.uint64).view(np.int64).tolist()
        sets = [shingles(x) for x in words]
        sizes = [len(x) for x in sets]
        return {"row": batch["row"], "point": points, "size": sizes, "bands": [bands(x) for x in sets]}

    return stored(by_batch(some, function, "row bigint, point bigint, size bigint, bands array<bigint>"), "bands")


def _sets(rows: DataFrame, key: str, text: str, nodes: DataFrame) -> DataFrame:
    """``node`` and ``hashes`` of the texts that share a bucket with another."""
    some = rows.select(F.col(key).alias("node"), text_of(F.col(text)).alias("text"))
    some = some.join(nodes, "node", "left_semi")

    def function(batch: dict[str, list]) -> dict[str, list]:
        found = [shingles(words_of(x)) for x in batch["text"]]
        return {"node": batch["node"], "hashes": [x.tobytes() for x in found]}

    return stored(by_batch(some, function, "node bigint, hashes binary"), "shingles")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``low`` and ``high``, the roots of the pairs ``a``, ``b`` of similarity ``LEAST`` or more."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")

    def function(batch: dict[str, list]) -> dict[str, list]:
        near = [similar(x, y) for x, y in zip(batch["x"], batch["y"], strict=True)]
        return {name: [v for v, ok in zip(batch[name], near, strict=True) if ok] for name in ("low", "high")}

    return stored(by_batch(both.select("low", "high", "x", "y"), function, "low bigint, high bigint"), "similar")


def _joined(found: DataFrame | None, roots: DataFrame) -> DataFrame:
    """Groups whose roots hang on others now. Both have ``node`` and ``root``; no root is a node of ``found``."""
    if found is None:
        return roots
    moved = roots.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return found.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")).unionByName(roots)


def _shared(dealt: DataFrame) -> DataFrame:
    """``bucket``, ``node``, ``size``, ``root`` of the buckets that hold several components.

    ``main`` is the largest component of the bucket, ``few`` says that at most ``FEW`` members
    lie outside it.
    """
    sizes = dealt.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    ends = sizes.groupBy("bucket").agg(
        F.count("*").alias("roots"), F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("most")
    )
    few = (F.col("all") - F.col("most.n") <= FEW).alias("few")
    open_ones = stored(ends.where("roots > 1").select("bucket", F.col("most.root").alias("main"), few), "buckets")
    return stored(dealt.join(open_ones, "bucket"), "members")


def linked(rows: DataFrame, key: str, text: str = "text", given: DataFrame | None = None) -> DataFrame:
    """``key`` and ``component_id`` of rows with a unique, not null ``key`` (a bigint).

    Texts link at ``LEAST`` or more of their distinct shingles, or with the same words;
    the component is the smallest key reachable by links. Empty and null texts are copies
    of each other. The rows have to be a written table. ``given`` (``key`` and
    ``component_id``) are groups that hold already, of rows with the same words at least;
    their members are not compared again.
    """
    signs = _signatures(rows, key, text)
    points = stored(signs.groupBy("point").agg(F.min("row").alias("node")), "points")
    one = signs.join(points.select(F.col("node").alias("row")), "row", "left_semi")
    found, many, first = None, 1, None
    if given is not None:
        own = given.select(F.col(key).alias("node"), F.col("component_id").alias("root"))
        found = stored(own.where("node <> root").join(points.select("node"), "node", "left_semi"), "given")
        one = one.join(found.withColumnRenamed("node", "row"), "row", "left")
    root = F.col("row") if given is None else F.coalesce("root", "row")
    members = _shared(
        one.select(F.explode("bands").alias("bucket"), F.col("row").alias("node"), "size", root.alias("root"))
    )
    sets = _sets(rows, key, text, members.select("node").distinct())
    while rest := members.count():
        first = first or rest
        # Few members may meet many representatives: a round proposes no more than the first ones did.
        many = max(many, GROWTH * first // rest) if many > 1 else many
        # The same for all buckets, so that a pair that shares several is compared once.
        salt = F.pmod(F.xxhash64("node", F.lit(many)), F.lit(many))
        last = F.col("few") & F.lit(many > 1)
        salt = F.when(last, F.col("node")).otherwise(salt)
        chosen = members.where(~last | (F.col("root") != F.col("main"))).groupBy("bucket", salt.alias("salt"))
        chosen = chosen.agg(F.min(F.struct("node", "root", "size")).alias("r"))
        names = [F.col("r.node").alias("to"), F.col("r.root").alias("to_root"), F.col("r.size").alias("to_size")]
        chosen = stored(chosen.select("bucket", *names), "chosen")
        # Sets of very different sizes cannot be similar, whatever they share.
        close = F.least("size", "to_size") >= F.lit(LEAST) * F.greatest("size", "to_size") - F.lit(1e-9)
        pairs = members.join(chosen, "bucket").where((F.col("root") != F.col("to_root")) & close)
        ends = [F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")]
        roots = [F.least("root", "to_root").alias("low"), F.greatest("root", "to_root").alias("high")]
        links = _verified(pairs.select(*ends, *roots).distinct(), sets)
        if not links.isEmpty():
            found = stored(_joined(found, components(links, "low", "high")), "found")
        left = members.where(~last).select("bucket", "node", "size").join(
            chosen.select("bucket", F.col("to").alias("node")), ["bucket", "node"], "left_anti"
        )
        if found is not None:
            left = left.join(found, "node", "left")
        root = F.col("node") if found is None else F.coalesce("root", "node")
        left = left.select("bucket", "node", "size", root.alias("root"))
        members = _shared(left)
        many *= GROWTH
    if found is not None:
        points = stored(
            points.join(found, "node", "left").select("point", F.coalesce("root", "node").alias("node")), "placed"
        )
    # Written tables, so that rows of a frequent text can be split.
    placed = signs.select("row", "point").join(points, "point")
    return placed.select(F.col("row").alias(key), F.col("node").alias("component_id"))
