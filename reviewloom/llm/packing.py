"""Packing documents into windows with a controlled mixture of sources.

Every source is a queue of documents in the order of a hash. In each round a source may send
its quantum, its target share of one window; a packet goes out in the round in which its
queue's turn reaches it, and what it overdraws is carried into the next rounds as a deficit.
So the round of a packet is the tokens before it in its queue over the quantum: running sums
tell it, in any partition, without running the rounds one by one. Packets are then laid end
to end by round, source and place, and cut where a window ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import by_task, same, slices, text_of
from reviewloom.llm.encoders import ByteEncoder
from reviewloom.operators.durable import stored

WINDOW, PACKET = 2048, 512
END_ID = 1
# Rows of a queue in one bucket, about; rounds in one bucket; buckets that are added up at once.
_QUEUE, _ROUNDS, _UPPER = 10_000, 256, 4096


class Encoder(ByteEncoder):
    """Whole texts as the bytes of their ids, in the smallest kind of integer, and the end."""

    def __call__(self, text: str) -> bytes:
        return np.array([*self.ids(text), END_ID], self.kind).tobytes()


def token_rows(docs: DataFrame, key: str, text: str, source: str, tokenizer: str, ranks: str | None) -> DataFrame:
    """Written: ``row`` (a number of its own), ``id``, ``source``, ``ids``, ``n``."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).cast("string").alias("id"),
        F.col(source).cast("string").alias("source"),
        text_of(F.col(text)).alias("text"),
    )

    def start() -> Callable[[dict[str, list]], dict[str, list]]:
        encode = Encoder(tokenizer, ranks)

        def function(batch: dict[str, list]) -> dict[str, list]:
            found = list(map(encode, batch["text"]))
            size = encode.kind.itemsize
            rest = {c: batch[c] for c in ("row", "id", "source")}
            return rest | {"ids": found, "n": [len(x) // size for x in found]}

        return function

    found = by_task(rows, start, "row bigint, id string, source string, ids binary, n bigint")
    return stored(found.withColumn("id", F.col("id").cast(kind)), "tokens")


def _running(
    rows: DataFrame, groups: list[str], bucket: str, order: list[str], value: str, name: str
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows before, by bucket and then order.

    Only totals of buckets, and above them of many buckets, are added up in one place.
    """
    groups_of = [F.col(g) for g in groups]
    totals = rows.groupBy(*groups_of, bucket).agg(F.sum(value).alias("_total"))
    totals = stored(totals.withColumn("_upper", F.floor(F.col(bucket) / F.lit(_UPPER))), "bucket-totals")
    uppers = totals.groupBy(*groups_of, "_upper").agg(F.sum("_total").alias("_sum"))
    before = (Window.unboundedPreceding, -1)
    over_uppers = Window.partitionBy(*groups_of).orderBy("_upper").rowsBetween(*before)
    uppers = uppers.select(
        *groups, "_upper", F.coalesce(F.sum("_sum").over(over_uppers), F.lit(0)).alias("_far")
    )
    inside = Window.partitionBy(*groups_of, "_upper").orderBy(bucket).rowsBetween(*before)
    near = totals.withColumn("_near", F.coalesce(F.sum("_total").over(inside), F.lit(0)))
    renamed = uppers.select(*[F.col(g).alias(f"_u{i}") for i, g in enumerate(groups)], F.col("_upper").alias("_u"), "_far")
    match = F.col("_upper") == F.col("_u")
    for i, g in enumerate(groups):
        match = match & same(F.col(g), F.col(f"_u{i}"))
    offsets = near.join(renamed, match).select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col(bucket).alias("_b"),
        (F.col("_near") + F.col("_far")).alias("_before"),
    )
    offsets = stored(offsets, "bucket-offsets")
    place = F.col(bucket) == F.col("_b")
    for i, g in enumerate(groups):
        place = place & same(F.col(g), F.col(f"_g{i}"))
    in_bucket = Window.partitionBy(*groups_of, bucket).orderBy(*order).rowsBetween(*before)
    local = rows.withColumn("_local", F.coalesce(F.sum(value).over(in_bucket), F.lit(0)))
    return local.join(offsets, place).select(
        *[F.col(c) for c in rows.columns], (F.col("_local") + F.col("_before")).alias(name)
    )


def _shares(rows: DataFrame, weights: Mapping[str | None, float] | None) -> DataFrame:
    """``_source``, ``share`` of a window and ``rank`` of each source: one row per source."""
    totals = rows.groupBy("source").agg(F.sum("n").cast("double").alias("weight"))
    if weights is not None:
        pairs = [(name, float(weight)) for name, weight in weights.items() if weight > 0]
        given = rows.sparkSession.createDataFrame(pairs, "_name string, _weight double")
        least = min((weight for _, weight in pairs), default=1.0)
        totals = totals.join(given, same(F.col("source"), F.col("_name")), "left").select(
            "source", F.coalesce("_weight", F.lit(least)).alias("weight")
        )
    everything = Window.partitionBy(F.lit(1))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return totals.select(
        F.col("source").alias("_source"),
        (F.col("weight") / F.sum("weight").over(everything)).alias("share"),
        F.row_number().over(order).alias("rank"),
    )


def layout(
    tokens: DataFrame, window: int, packet: int, weights: Mapping[str | None, float] | None
) -> DataFrame:
    """Pieces without their ids: ``row``, ``start``, ``length``, ``sequence_id``, ``offset``."""
    rows = tokens.select("row", "source", "n")
    number = rows.count()
    buckets = max(64, number // _QUEUE)
    shares = stored(_shares(rows, weights), "shares")
    queued = rows.join(shares, same(F.col("source"), F.col("_source"))).select(
        "row", "rank", "share", "n", F.xxhash64("row").alias("turn")
    )
    queued = queued.withColumn("bucket", F.pmod("turn", F.lit(buckets)))
    queued = _running(queued, ["rank"], "bucket", ["turn", "row"], "n", "queue_at")
    step = F.lit(packet)
    packets = queued.select(
        "row", "rank", "share", "queue_at", "n",
        F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / step).cast("bigint") * step, step)).alias("start"),
    ).select(
        "row", "rank", "start",
        F.least(step.cast("bigint"), F.col("n") - F.col("start")).alias("size"),
        F.floor((F.col("queue_at") + F.col("start")) / (F.col("share") * F.lit(window))).alias("round"),
        (F.col("queue_at") + F.col("start")).alias("place"),
    )
    packets = stored(packets.withColumn("bucket", F.floor(F.col("round") / F.lit(_ROUNDS))), "packets")
    laid = _running(packets, [], "bucket", ["round", "rank", "place"], "size", "at")
    first, last = F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("size") - 1) / window)
    cut = laid.select("row", "start", "size", "at", F.explode(F.sequence(first, last)).alias("sequence_id"))
    begin = F.greatest(F.col("at"), F.col("sequence_id") * F.lit(window))
    end = F.least(F.col("at") + F.col("size"), (F.col("sequence_id") + 1) * F.lit(window))
    return cut.select(
        "row",
        (F.col("start") + begin - F.col("at")).alias("start"),
        (end - begin).alias("length"),
        "sequence_id",
        (begin - F.col("sequence_id") * F.lit(window)).alias("offset"),
    )


def _pieces(part: pa.RecordBatch) -> pa.RecordBatch:
    """The pieces of some documents. Those of a document, in the order of their start, are the
    document again, so the ids stay as they lie and only get new ends."""
    listed = part.column("ids").to_pylist()
    total = part.column("n").to_numpy()
    cuts, whole = part.column("cuts"), b"".join(listed)
    number = np.diff(cuts.offsets.to_numpy())
    ids = np.frombuffer(whole, f"<u{len(whole) // max(1, int(total.sum()))}").astype("<u4")
    fields = {name: cuts.flatten().field(name) for name in ("start", "length", "sequence_id", "offset")}
    ends = np.concatenate([[0], np.cumsum(4 * fields["length"].to_numpy())]).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(ids)])
    row = pa.array(np.repeat(np.arange(part.num_rows), number))
    columns = {
        "id": part.column("id").take(row), "start": fields["start"], "length": fields["length"], "ids": pieces,
        "doc_tokens": part.column("n").take(row), "sequence_id": fields["sequence_id"], "offset": fields["offset"],
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def packed(
    docs: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    window: int = WINDOW,
    packet: int = PACKET,
    weights: Mapping[str | None, float] | None = None,
) -> DataFrame:
    """One row per piece: ``key``, ``start``, ``length``, ``ids``, ``doc_tokens``,
    ``sequence_id``, ``offset``.

    A document is its ids and then the id 1. ``ids`` are little-endian unsigned 32-bit.
    ``weights`` are target shares of sources (the smallest one for those not named); without
    them the target is the share in all tokens, so that all queues end together. With given
    weights a queue that ends leaves its place to the others. No packet has more than
    ``packet`` tokens, so a source is never further from its target; only the last sequence
    can be short.

    Edges: null and empty texts are the id 1 alone; null is a source of its own; rows that
    share a key are packed each; an empty table gives no rows.
    """
    tokens = token_rows(docs, key, text, source, tokenizer, ranks)
    pieces = layout(tokens, window, packet, weights)
    kind = tokens.schema["id"].dataType.simpleString()
    # All pieces of one document, so at most its length.
    cuts = pieces.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("cuts")
    )
    joined = tokens.join(cuts, "row").select(F.col("id").cast("string").alias("id"), "ids", "n", "cuts")
    out = "id string, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids"):
                yield _pieces(part)

    found = joined.mapInArrow(cut, out)
    return found.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", key)
