"""Near-copies by SimHash, linked through vantage-point trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm import vptree
from reviewloom.llm.common import by_batch, text_of
from reviewloom.llm.components import components
from reviewloom.operators.durable import stored

SHINGLE, SEED, MOST, FIELDS = 4, 42, 4, 3
# Distinct fingerprints that live in one shard, about; fingerprints per leaf of the sample.
SHARD, SAMPLE = 16_384, 64
_ROWS = 1 << 16
ROW = "_row"


def fingerprint(text: str, words_per_shingle: int = SHINGLE) -> int:
    """Bit by bit the majority over the hashes of all word shingles; no words: zero."""
    # Splitting bytes parts words at exactly space and the control characters 9 to 13.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(words_per_shingle, len(words))
    ends = np.cumsum([len(word) + 1 for word in words])
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), _ROWS):
        hashes = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _ROWS], stops[at : at + _ROWS], strict=True)],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    majority = 2 * counts > len(starts)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fp``, the fingerprint as a signed long. A null text has no words."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("bigint").alias("id"), text_of(F.col(text)).alias("text"))

    def function(batch: dict[str, list]) -> dict[str, list]:
        return {"id": batch["id"], "fp": [_signed(fingerprint(x)) for x in batch["text"]]}

    found = by_batch(rows, function, "id bigint, fp bigint")
    return found.select(F.col("id").cast(kind).alias(key), "fp")


def _links(points: DataFrame, most: int, fields: int) -> DataFrame:
    """Links ``fp``, ``root`` that join all distinct points within ``most`` bits."""
    masks, radius = vptree.field_masks(fields), most // fields
    number = points.count()
    depth = max(4, math.ceil(math.log2(max(number, 1) / SHARD)))
    chosen = points.orderBy(F.xxhash64("fp"), "fp").limit(min(SAMPLE << depth, 1 << 20))
    sample = np.array([row.fp for row in chosen.collect()], np.int64).view(np.uint64)
    trees = [vptree.fit(sample, mask, depth) for mask in masks]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for field, tree in enumerate(trees):
                index, leaf, home = vptree.route(tree, own, radius)
                shard = leaf + (field << depth)
                yield pd.DataFrame({"shard": shard, "fp": own[index].view(np.int64), "home": home})

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame["fp"].to_numpy(np.int64).view(np.uint64)
        mask = masks[int(frame["shard"].iloc[0]) >> depth]
        roots = vptree.link(own, frame["home"].to_numpy(bool), mask, radius, most)
        linked = roots != np.arange(len(own))
        return pd.DataFrame({"fp": own[linked].view(np.int64), "root": own[roots[linked]].view(np.int64)})

    dealt = points.mapInPandas(deal, "shard bigint, fp bigint, home boolean")
    return dealt.groupBy("shard").applyInPandas(join, "fp bigint, root bigint")


def near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST, fields: int = FIELDS
) -> DataFrame:
    """One row per document: ``key``, ``fp``, ``component_id``.

    Fingerprints link at ``most`` or fewer differing bits; ``component_id`` is the smallest
    key reachable by links. Equal fingerprints are one point of the trees, however many
    documents carry them. Edges: empty and null texts have fingerprint zero; rows that share
    a key are rows of their own; rows with a null key link others but name no component
    (alone, theirs is null); an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, key, text), "fingerprints")
    points = stored(rows.groupBy("fp").agg(F.min(key).alias("least")), "points")
    rooted = components(_links(points.select("fp"), most, fields), "fp", "root")
    placed = points.join(rooted, points.fp == rooted.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least"
    )
    placed = stored(placed, "placed")
    named = stored(placed.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    # Written, so that documents of a frequent fingerprint can be split.
    by_point = stored(placed.join(named, "root").select("fp", "component_id"), "by-point")
    return rows.join(by_point, "fp").select(key, "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def numbered(docs: DataFrame) -> DataFrame:
    """Written, with ``_row``: a number that no other row has."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def first_of_each(rows: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of numbered rows one per component: the smallest key, of equal keys the first row.

    A null key is larger than any other. ``found`` has ``_row`` and ``component_id``.
    """
    own = rows.select(ROW, F.col(f"`{key}`").alias("id")).join(found.select(ROW, "component_id"), ROW)
    order = F.struct(F.col("id").isNull().alias("none"), "id", ROW)
    first = own.groupBy("component_id").agg(F.min(order).alias("first")).select(f"first.{ROW}")
    kept = rows.join(first, ROW, "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in rows.columns if c != ROW])


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """One row of each component, decided by row: keys may be null or repeated."""
    rows = numbered(docs)
    return first_of_each(rows, near_copies(rows, ROW, text, most), key)
