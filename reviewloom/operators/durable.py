"""Tables that outlive the executors, and lookups that are broadcast only when small."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A lookup table is broadcast up to this many bytes of values.
BROADCAST_BYTES = 64 * 1024 * 1024

# A task of a large shuffle holds about this many bytes of rows, taken as ROW_BYTES each.
TASK_BYTES = 96 * 1024 * 1024
ROW_BYTES = 96

# Spark removes the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a local session that names none gets a folder of its own.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="reviewloom-"))
    return context.getCheckpointDir()


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stored-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, label: str, *more: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and go on from the written table.

    This cuts the lineage: later steps read the table with column pruning and known size,
    and neither a lost executor nor a second use computes the rows again. ``more`` rows of
    the same columns are written after the first, when what those shuffled is gone.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    # Nobody asks again for what was shuffled on the way to a written table.
    spark.conf.set(_CLEANUP, "true")
    try:
        for part in (df, *more):
            part.write.mode("append").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Remove the written tables that these read, when what was made of them is written too."""
    for df in tables:
        spark = df.sparkSession
        mark = f"/stored-{spark.sparkContext.applicationId}/"
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles() if mark in file}:
            _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def remove_stored(spark: SparkSession) -> None:
    """Remove all tables that :func:`stored` wrote in this session.

    To be called when their readers are done; other files in the shared folder stay.
    """
    context = spark.sparkContext
    if not (context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        return
    _delete(spark, _own_folder(spark))


def _value_bytes(field: T.StructField):
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + F.lit(16)
    if isinstance(field.dataType, T.ArrayType):
        return F.greatest(F.size(column), F.lit(0)) * F.lit(8) + F.lit(16)
    return F.lit(8)


def measured_bytes(df: DataFrame) -> int:
    """The size of the rows, added up over a stored table (strings, numbers, vectors)."""
    row_bytes = sum((_value_bytes(field) for field in df.schema.fields), F.lit(16))
    return df.agg(F.sum(row_bytes.cast("bigint")).alias("bytes")).first()["bytes"] or 0


def lookup(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table for joining: broadcast when its measured size allows it.

    A larger one stays as it is, and the join shuffles both sides; adaptive execution
    then splits the partitions of frequent keys.
    """
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df


def stored_lookup(df: DataFrame, label: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """:func:`stored` and :func:`lookup` in one.

    Totals that are joined back to the rows they came from go through here as well. Were
    the aggregate part of the same plan, the join would use its partitioning as it is, and
    adaptive execution could not split the partition of a hot key; a written table gets a
    shuffle of its own, which it can.
    """
    return lookup(stored(df, label), max_bytes)


def _tasks(df: DataFrame, size: float) -> int:
    """How many tasks so many bytes are dealt to; few bytes go to as many as there are cores at most."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(size / TASK_BYTES), min(cores, math.ceil(50 * size / TASK_BYTES)))


def dealt(rows: DataFrame, *keys: str, number: int | None = None) -> DataFrame:
    """The rows dealt by the keys, so many to a task that they fit whatever the session's settings.

    Adaptive execution would join partitions by their compressed size, and ids and indices
    take ten times that in memory. No key may have a large part of the rows. ``number`` is that
    of the rows, or more, where counting them would compute them.
    """
    number = rows.count() if number is None else number
    return rows.repartition(_tasks(rows, number * ROW_BYTES), *keys)


def joined(
    rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", number: int | None = None
) -> DataFrame:
    """A join with a stored table: broadcast when small, else both sides as :func:`dealt`."""
    size = measured_bytes(table)
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), keys, how)
    number = rows.count() if number is None else number
    tasks = _tasks(rows, number * ROW_BYTES + 2 * size)
    return rows.repartition(tasks, *keys).join(table.repartition(tasks, *keys), keys, how)


def _frequent_keys(rows: DataFrame, entries: DataFrame, key: str, max_bytes: int) -> DataFrame | None:
    """The most frequent keys of the rows (``stored``), as many as have entries of ``max_bytes``.

    They are all keys of at least some power of two of rows; None if not even the few at
    the top fit.
    """
    return _frequent_and_rest(rows, entries, key, max_bytes)[0]


def _frequent_and_rest(
    rows: DataFrame, entries: DataFrame, key: str, max_bytes: int
) -> tuple[DataFrame | None, int]:
    """:func:`_frequent_keys`, and the number of rows that have other keys."""
    number = max(entries.count(), 1)
    width = measured_bytes(entries) / number + 32
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    counts = stored(counts, "key-counts")
    # At most one row for each power of two.
    power = (F.length(F.bin("_n")) - 1).alias("power")
    sizes = counts.groupBy(power).agg(F.count("*").alias("keys"), F.sum("_n").alias("rows"))
    room, least, rest = max_bytes / width, None, 0
    for size in sorted(sizes.collect(), reverse=True):
        room -= size["keys"]
        if room < 0:
            rest += size["rows"]
        else:
            least = 1 << size["power"]
    return None if least is None else counts.where(F.col("_n") >= least).select(key), rest


def with_entries(
    rows: DataFrame,
    entries: DataFrame,
    key: str,
    max_bytes: int | None = None,
) -> DataFrame:
    """The rows with the entries of their ``key``; those of keys without an entry drop out.

    Both are stored tables. A small table of entries is broadcast. Of a larger one the entries
    of the most frequent keys are broadcast, and only rows of the others are shuffled: most
    rows stay where they are, and no key that is shuffled is a hot one.
    """
    if max_bytes is None:
        max_bytes = BROADCAST_BYTES
    size = measured_bytes(entries)
    if size <= max_bytes:
        return rows.join(F.broadcast(entries), key)
    # Two tables are broadcast: the keys, and their entries.
    frequent, rest = _frequent_and_rest(rows, entries, key, max_bytes // 2)
    if frequent is None:
        return rows.join(entries, key)
    tasks = _tasks(rows, rest * ROW_BYTES + 2 * size)
    frequent = F.broadcast(frequent)
    marked = rows.join(frequent.withColumn("_frequent", F.lit(True)), key, "left")
    near = marked.where(F.col("_frequent")).drop("_frequent")
    rare = marked.where(F.col("_frequent").isNull()).drop("_frequent").repartition(tasks, key)
    at_hand = F.broadcast(entries.join(frequent, key, "left_semi"))
    others = entries.join(frequent, key, "left_anti").repartition(tasks, key)
    return near.join(at_hand, key).unionByName(rare.join(others, key))
