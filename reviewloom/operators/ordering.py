"""Global row numbers and running sums without a window over all rows.

The rows are sorted once into range partitions and written out together with the
partition and the place in it. Each partition is then counted (or summed); only these few
partition totals are accumulated in one place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators.durable import stored

_SLOT = "_slot"
_PART = "_part"
_TIE = "_tie"

# The upper bits of monotonically_increasing_id number the partition, these the row in it.
_ROW_BITS = 33


def _sorted_slots(df: DataFrame, order_by: Sequence[Column | str], label: str) -> DataFrame:
    if not order_by:
        slotted = df.withColumn(_SLOT, F.monotonically_increasing_id())
        return stored(slotted, label).withColumn(_PART, F.shiftright(_SLOT, _ROW_BITS))
    # The tie breaker lets equal rows go to different partitions, however many they are.
    ordered = df.withColumn(_TIE, F.monotonically_increasing_id()).orderBy(*order_by, _TIE)
    slotted = ordered.drop(_TIE).withColumn(_SLOT, F.monotonically_increasing_id())
    return stored(slotted, label).withColumn(_PART, F.shiftright(_SLOT, _ROW_BITS))


def _sums_before(slots: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    """For every partition, the sums over all partitions before it."""
    totals = slots.groupBy(_PART).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums]
    # One row per partition of the sort, so always small.
    return F.broadcast(totals.select(_PART, *offsets))


def numbered(
    df: DataFrame, order_by: Sequence[Column | str], name: str, start: int = 0
) -> DataFrame:
    """Add ``name``: ``start``, ``start + 1`` and so on in the given order, without gaps.

    Without an order the rows keep their partitions and places.
    """
    slots = _sorted_slots(df, order_by, name)
    offsets = _sums_before(slots, {"_offset": F.lit(1)})
    place = F.col(_SLOT) - F.shiftleft(F.col(_PART), _ROW_BITS)
    return (
        slots.join(offsets, _PART)
        .withColumn(name, F.col("_offset") + place + F.lit(start))
        .drop(_SLOT, _PART, "_offset")
    )


def running_sums(
    df: DataFrame, order_by: Sequence[Column | str], sums: Mapping[str, Column]
) -> DataFrame:
    """Add for each name the sum of its column over all rows before the current one."""
    slots = _sorted_slots(df, order_by, "running")
    offsets = _sums_before(slots, {f"_{name}": column for name, column in sums.items()})
    in_part = (
        Window.partitionBy(_PART).orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, -1)
    )
    added = slots.join(offsets, _PART)
    for name, column in sums.items():
        local = F.coalesce(F.sum(column).over(in_part), F.lit(0))
        added = added.withColumn(name, local + F.col(f"_{name}"))
    return added.drop(_SLOT, _PART, *[f"_{name}" for name in sums])


def preceding(
    df: DataFrame, order_by: Sequence[Column | str], columns: Mapping[str, Column]
) -> DataFrame:
    """Add for each name the value of its column in the row before; null in the first row."""
    slots = _sorted_slots(df, order_by, "preceding")
    values = F.struct(*[column.alias(name) for name, column in columns.items()])
    lasts = slots.groupBy(_PART).agg(F.max_by(values, F.col(_SLOT)).alias("_last"))
    # One row per partition of the sort, so always small.
    carried = F.broadcast(lasts.select(_PART, F.lag("_last").over(Window.orderBy(_PART)).alias("_carried")))
    in_part = F.lag(values).over(Window.partitionBy(_PART).orderBy(_SLOT))
    added = slots.join(carried, _PART).withColumn("_before", F.coalesce(in_part, F.col("_carried")))
    kept = [F.col(f"`{name}`") for name in df.columns]
    return added.select(*kept, *[F.col("_before")[name].alias(name) for name in columns])
