"""Small helpers that the operators of this package share.

All operators take the columns they need under names of their own, so that other columns of
a table, whatever they are called, cannot get in the way. A column that an operator returns
replaces an input column of that name.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# The white space that parts words: space and the control characters 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_WORD = r"[^\x20\x09-\x0D]+"


_PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Let the Python workers of this session import the package, wherever they start."""
    context = spark.sparkContext
    name = f"{_PACKAGE.name}-{context.applicationId}.zip"
    if any(Path(path).name == name for path in context.listFiles):
        return
    path = Path(tempfile.mkdtemp(prefix="package-")) / name
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(_PACKAGE.rglob("*.py")):
            archive.write(file, file.relative_to(_PACKAGE.parent))
    context.addPyFile(str(path))


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: Column | str) -> Column:
    """A text; null reads as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))).cast("bigint")


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def parts(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that few rows at a time stand in Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def slices(batch: pa.RecordBatch, column: str, rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many rows and, from the second row on, bytes of a text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = before = 0
    while at < batch.num_rows:
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, stop - at)
        at, before = stop, int(ends[stop - 1])


def by_task(
    df: DataFrame, start: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str
) -> DataFrame:
    """As :func:`by_batch`, with a function that ``start`` makes anew for every task.

    What the function keeps, such as a vocabulary, goes with the task: a worker process, which
    Spark uses again, holds nothing for later stages.
    """
    target = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()
        for batch in batches:
            for part in parts(batch):
                found = function(part.to_pydict())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[f.name], f.type) for f in target], schema=target
                )

    return df.mapInArrow(run, schema)


def by_batch(
    df: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: str
) -> DataFrame:
    """Rows through a function of whole Arrow batches: columns in, columns out.

    Spark bounds a batch in rows and in bytes, so very long texts come few at a time.
    """
    return by_task(df, lambda: function, schema)
