"""Hard negatives by a vertical scan with branch and bound (BOND).

Vectors lie in blocks, column by column. An anchor reads the columns of a block in the
order of its own magnitudes, the largest first. What the columns still unread can add at
least and at most follows from the smallest and largest value of each column, so every partial
score has bounds, and the bitmap of candidates shrinks: of the rows that can still be among
the nearest positives, or that can still fall into one of the score windows of the anchor and
be among the first there. What is left when all columns are read has its exact score.

Blocks of rows meet chunks of anchors in the cells of a grid, so no task holds more than one
of each. Every cell hands on a few rows for each anchor.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import parts
from reviewloom.operators.durable import stored

# Rows in a block and anchors in a chunk, at most about; columns between two looks at the bounds.
BLOCK, CHUNK, STEP = 16_384, 16_384, 8
# Sums of products up to here are exact in double precision.
_EXACT = 1 << 53


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    negatives: int = 3
    # A negative's score lies between these hundredths of the score of its positive.
    low: int = 50
    high: int = 95


class Block:
    """Rows column by column, in the order of their ids, which settles ties."""

    def __init__(self, frame: pd.DataFrame):
        frame = frame.sort_values(["id", "row"], na_position="last", kind="stable")
        self.rows, self.labels = frame["row"].to_numpy(np.int64), frame["label"].to_numpy(np.int64)
        self.columns = np.ascontiguousarray(_matrix(frame["v"]).T)
        self.least, self.most = self.columns.min(axis=1), self.columns.max(axis=1)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<i4").reshape(len(vectors), -1).astype(np.float64)


Stay = Callable[[np.ndarray, np.ndarray], np.ndarray]


def scan(block: Block, anchor: np.ndarray, bitmap: np.ndarray, stay: Stay) -> tuple[np.ndarray, np.ndarray]:
    """The candidates left of a bitmap, ascending, and their exact scores.

    After every few columns ``stay`` gets lower and upper bounds of the scores of the
    candidates left and says which of them go on.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.stack([anchor * block.least, anchor * block.most])[:, order]
    # What the columns from a place on can add.
    least = np.append(np.cumsum(ends.min(axis=0)[::-1])[::-1], 0.0)
    most = np.append(np.cumsum(ends.max(axis=0)[::-1])[::-1], 0.0)
    alive = np.flatnonzero(bitmap)
    scores = np.zeros(len(alive))
    for at in range(0, len(order), STEP):
        if not len(alive):
            break
        read = order[at : at + STEP]
        if 2 * len(alive) < len(bitmap):
            scores += anchor[read] @ block.columns[read[:, None], alive]
        else:
            scores += (anchor[read] @ block.columns[read])[alive]
        end = at + len(read)
        on = stay(scores + least[end], scores + most[end])
        if not on.all():
            alive, scores = alive[on], scores[on]
    return alive, scores


def among_first(number: int) -> Stay:
    """Candidates that can be among the first ``number`` by score."""

    def stay(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        if len(lower) <= number:
            return np.ones(len(lower), bool)
        return upper >= np.partition(lower, -number)[-number]

    return stay


def in_windows(windows: list[tuple[float, float]], number: int) -> Stay:
    """Candidates that can be among the first ``number`` by score of one of the windows."""
    floor, roof = min(low for low, _ in windows), max(high for _, high in windows)

    def stay(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        on = (upper >= floor) & (lower <= roof)
        some = np.flatnonzero(on)
        low_of, high_of = lower[some], upper[some]
        needed = np.zeros(len(some), bool)
        for low, high in windows:
            sure = low_of[(low_of >= low) & (high_of <= high)]
            # As many are in this window for sure, at this score or above.
            enough = np.partition(sure, -number)[-number] if len(sure) >= number else low
            needed |= (high_of >= enough) & (low_of <= high)
        on[some] = needed
        return on

    return stay


def _first(alive: np.ndarray, scores: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-scores, kind="stable")[:number]
    return alive[order], scores[order]


def windows_of(scores: list[int], s: Settings) -> list[tuple[float, float]]:
    """For each score of a positive the least and largest score of its negatives."""
    return [(float(-(-s.low * score // 100)), float(s.high * score // 100)) for score in scores]


def _vectors(rows: DataFrame, key: str, vector: str, label: str, scale: int, every: int) -> DataFrame:
    """Written: ``row``, ``id``, ``label``, ``anchor`` and ``v``, 32-bit integers."""
    scaled = lambda x: x.cast("double") * F.lit(scale)
    # Not a number is larger than any here; the final bound is smaller still.
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(scaled(x)) < F.lit(float(1 << 31))))
    whole = F.transform(vector, lambda x: F.floor(scaled(x)))
    table = rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).cast("bigint").alias("id"),
        F.col(label).cast("bigint").alias("label"),
        F.when(finite, whole).alias("whole"),
    ).where(F.col("label").isNotNull() & F.col("whole").isNotNull())
    size = max(1, table.agg(F.max(F.size("whole"))).first()[0] or 0)
    bound = math.isqrt(_EXACT // size)
    table = table.where(F.forall("whole", lambda x: F.abs(x) <= F.lit(bound)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1024):
                found = np.zeros((part.num_rows, size), "<i4")
                for n, values in enumerate(part.column("whole")):
                    found[n, : len(values.values)] = values.values.to_numpy()
                packed = pa.array([row.tobytes() for row in found], pa.binary())
                rest = [part.column(name) for name in ("row", "id", "label")]
                yield pa.RecordBatch.from_arrays([*rest, packed], names=["row", "id", "label", "v"])

    found = table.mapInArrow(run, "row bigint, id bigint, label bigint, v binary")
    anchor = F.coalesce(F.col("id") % F.lit(every) == 0, F.lit(False))
    return stored(found.withColumn("anchor", anchor), "integer-vectors")


_FOUND = "anchor bigint, place int, id bigint, row bigint, score double"


def _cells(blocks: DataFrame, anchors: DataFrame, number: tuple[int, int], work: Callable) -> DataFrame:
    """Every block of rows with every chunk of anchors, in a task of its own."""
    n_blocks, n_chunks = number
    each_chunk = F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk")
    each_block = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    block = F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int").alias("block")
    chunk = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_chunks)).cast("int").alias("chunk")
    left = blocks.select(block, "row", "id", "label", "v").select("*", each_chunk)
    right = anchors.select("*", chunk).select("*", each_block)

    def compare(rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found = {name: [] for name in ("anchor", "place", "at", "score")}
        if len(rows) and len(asking):
            own = Block(rows)
            vectors = _matrix(asking["v"])
            for n, ask in enumerate(asking.itertuples()):
                for place, alive, scores in work(own, vectors[n], ask):
                    found["anchor"] += [ask.row] * len(alive)
                    found["place"] += [place] * len(alive)
                    found["at"].append(alive)
                    found["score"].append(scores)
        if not found["at"]:
            return pd.DataFrame({name: [] for name in ("anchor", "place", "id", "row", "score")})
        row = own.rows[np.concatenate(found["at"])]
        ids = rows.set_index("row")["id"].loc[row].to_numpy()
        return pd.DataFrame(
            {"anchor": found["anchor"], "place": found["place"], "id": ids, "row": row, "score": np.concatenate(found["score"])}
        )

    cells = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))
    return cells.applyInPandas(compare, _FOUND)


def _ranked(found: DataFrame, number: int) -> DataFrame:
    """Of each anchor and place the first by score and id, with their ``rank``."""
    order = Window.partitionBy("anchor", "place").orderBy(
        F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")
    )
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= number)


def hard_negatives(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    every: int = 50,
    scale: int = 256,
    settings: Settings | None = None,
) -> DataFrame:
    """One row per hard negative: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``.

    A component x is the integer ``floor(scale * x)``, a score the integer inner product.
    Anchors are the rows whose key ``every`` divides. The positives of an anchor are its first
    rows of the same label, the negatives of a positive its first rows of another label with
    a score of ``low`` to ``high`` hundredths of that of the positive; higher scores come first,
    then smaller keys, then a null key.

    Edges: rows without a label, with a null vector or with null or non-finite components take no part,
    nor do components beyond ``sqrt(2 ** 53 / length)`` after scaling (some 11 million at 64
    components), whose products double precision cannot hold exactly. A shorter vector reads
    as if zeros followed. Rows that share a key are rows of their own; a null key is never an
    anchor. Without positives an anchor has no rows, and an empty table gives none.
    """
    s = settings or Settings()
    table = _vectors(rows, key, vector, label, scale, every)
    number, asking = table.agg(F.count("*"), F.count_if("anchor")).first()
    least = rows.sparkSession.sparkContext.defaultParallelism
    # More blocks than cores where the table is small; the result is the same for any number.
    grid = max(math.ceil(number / BLOCK), least, 1), max(math.ceil(asking / CHUNK), 1)
    anchors = table.where("anchor").select("row", "id", "label", "v")

    def nearest(block: Block, vector: np.ndarray, ask) -> Iterator[tuple]:
        bitmap = (block.labels == ask.label) & (block.rows != ask.row)
        yield 0, *_first(*scan(block, vector, bitmap, among_first(s.positives)), s.positives)

    positives = stored(_ranked(_cells(table, anchors, grid, nearest), s.positives), "positives")
    windows = positives.groupBy(F.col("anchor").alias("_anchor")).agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("score").cast("bigint").alias("score"))))["score"].alias("scores")
    )
    asked = stored(anchors.join(windows, F.col("row") == F.col("_anchor")).drop("_anchor"), "asking")

    def between(block: Block, vector: np.ndarray, ask) -> Iterator[tuple]:
        windows = windows_of([int(score) for score in ask.scores], s)
        bitmap = block.labels != ask.label
        alive, scores = scan(block, vector, bitmap, in_windows(windows, s.negatives))
        for place, (low, high) in enumerate(windows, 1):
            on = (scores >= low) & (scores <= high)
            yield place, *_first(alive[on], scores[on], s.negatives)

    found = stored(_ranked(_cells(table, asked, grid, between), s.negatives), "negatives")
    kind = rows.schema[key].dataType.simpleString()
    of = positives.select(
        F.col("anchor").alias("_anchor"), F.col("rank").alias("_place"),
        F.col("id").alias("positive_id"), F.col("score").cast("bigint").alias("positive_score"),
    )
    of = of.join(anchors.select(F.col("row").alias("_row"), F.col("id").alias("anchor_id")), F.col("_anchor") == F.col("_row"))
    joined = found.join(of, (F.col("anchor") == F.col("_anchor")) & (F.col("place") == F.col("_place")))
    return joined.select(
        F.col("anchor_id").cast(kind).alias("anchor_id"),
        F.col("positive_id").cast(kind).alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("id").cast(kind).alias("negative_id"),
        "positive_score",
        F.col("score").cast("bigint").alias("negative_score"),
    )
