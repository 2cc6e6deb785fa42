"""Recipe files, and what is fitted on recipes once and then loaded."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.ml.feature import Word2VecModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.functions.fixed_values import RECIPE_COLUMNS
from reviewloom.functions.text import join_words, recipe_words
from reviewloom.operators.durable import lookup, stored


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """The text columns of recipe CSV files with a header, in whatever order they come.

    All other columns are left out. See :func:`read_quoted_csv`.
    """
    return read_quoted_csv(spark, path, RECIPE_COLUMNS)


def _record(text: Column) -> Column:
    """Without the carriage return before the line feed that ended it."""
    return F.regexp_replace(text, r"\r\z", "")


def _lines_in_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the files, each with what the quotes before it in its block say (``stored``).

    ``odd``: whether they are odd in number. ``last_0`` and ``last_1``: the last line so far
    that has an even (odd) number before it. One of the two is where the record of the line
    starts; which one depends on the quotes in the blocks before.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    # A block is one split of a file, which bounds what comes together here.
    so_far = Window.partitionBy("file", "block").orderBy("line")
    before = F.coalesce(F.sum("quotes").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = lines.withColumn("quotes", quotes).withColumn("odd", (before % 2).cast("int"))
    last = [
        F.max(F.when(F.col("odd") == parity, F.col("line"))).over(so_far).alias(f"last_{parity}")
        for parity in (0, 1)
    ]
    return stored(marked.select("*", *last), "csv-lines")


def _blocks(lines: DataFrame) -> DataFrame:
    """Per block: ``open``, 1 if it begins within quotes, the record ``carried`` into it, and
    the ``header`` line in the first block of a file."""
    blocks = lines.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"),
        F.max(F.when(F.col("odd") == 0, F.col("line"))).alias("last_0"),
        F.max(F.when(F.col("odd") == 1, F.col("line"))).alias("last_1"),
        F.min(F.when(_record(F.col("value")) != "", F.col("line"))).alias("header"),
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = blocks.withColumn("open", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"))
    last = F.when(F.col("open") == 0, F.col("last_0")).otherwise(F.col("last_1"))
    found = opened.withColumn("last", F.when(last.isNotNull(), F.struct("block", last.alias("line"))))
    return found.select(
        "file", "block", "open", F.last("last", ignorenulls=True).over(before).alias("carried"), "quotes",
        F.when(F.col("block") == 0, F.col("header")).alias("header"),
    )


def read_quoted_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Those of the ``columns`` that the header names, as text; quoted fields may span lines.

    However large a file is, it is read by many tasks. Quotes are counted per line and
    added up per block of the file; lines with an even number of quotes before them start
    a record. Most records are one line and stay where they are, only the lines of longer
    ones are brought together. Spark's own parser then reads each record.

    Quotes within a quoted field are doubled; a field without quotes must hold none (a
    file whose quotes do not close is an error). Lines end in a line feed, with or
    without a carriage return. All files must have the same header. Blank lines between
    records are skipped; an empty field is null; files without a header give no columns.
    """
    lines = _lines_in_blocks(spark, path)
    blocks = stored(_blocks(lines), "csv-blocks")
    unclosed = blocks.groupBy("file").agg((F.sum("quotes") % 2).alias("odd")).where("odd = 1").first()
    if unclosed:
        raise ValueError(f"quotes do not close in {unclosed['file']}")
    places = lookup(blocks.drop("quotes"))
    own = F.when(F.col("open") == 0, F.col("last_0")).otherwise(F.col("last_1"))
    start = F.when(own.isNotNull(), F.struct("block", own.alias("line"))).otherwise(F.col("carried"))
    placed = lines.join(places, ["file", "block"]).withColumn("start", start)
    alone = (F.col("odd") == F.col("open")) & (F.col("quotes") % 2 == 0)
    single = placed.where(alone & (_record(F.col("value")) != "")).select(
        "value", "file", F.coalesce(F.col("line") == F.col("header"), F.lit(False)).alias("is_header")
    )
    pieces = F.sort_array(F.collect_list(F.struct("block", "line", "value")))
    joined = placed.where(~alone).groupBy("file", "start").agg(
        F.array_join(F.transform(pieces, lambda piece: piece["value"]), "\n").alias("value"),
        F.max(F.coalesce(F.col("line") == F.col("header"), F.lit(False))).alias("is_header"),
    )
    records = single.unionByName(joined.select("value", "file", "is_header"))
    records = records.withColumn("value", _record(F.col("value")))
    headers = records.where("is_header").select("value").distinct().limit(2).collect()
    if len(headers) > 1:
        raise ValueError(f"files with different headers: {headers[0]['value']!r}, {headers[1]['value']!r}")
    names = next(csv.reader([headers[0]["value"]])) if headers else []
    schema = ", ".join(f"c{n} string" for n in range(len(names))) or "c0 string"
    parsed = F.from_csv("value", schema, {"escape": '"'})
    rows = records.where("not is_header").select(parsed.alias("record"))
    return rows.select(*[F.col(f"record.c{names.index(name)}").alias(name) for name in columns if name in names])


def recipe_word_lists(
    recipes: DataFrame, columns: Sequence[str], compat: bool = False
) -> DataFrame:
    """Recipes with their ``words`` and the same as one ``text``."""
    with_words = recipes.withColumn("words", recipe_words(columns, compat))
    return with_words.withColumn("text", join_words(F.col("words")))


def artefact_path(folder: str, kind: str, columns: Sequence[str]) -> str:
    """Where a vocabulary or a word vector model of these recipe columns is kept."""
    return f"{folder}/{kind}_{'_'.join(columns)}"


def save_table(table: DataFrame, path: str) -> DataFrame:
    """Write a fitted table (vocabulary, weights, vectors) and return it as written."""
    table.write.mode("overwrite").parquet(path)
    return load_table(table.sparkSession, path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_word_vectors(path: str) -> Word2VecModel:
    return Word2VecModel.load(path)
