"""Review files and review tables."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions.text import (
    append_picture_words,
    fill_missing_text,
    picture_words,
)
from reviewloom.operators.durable import stored, stored_lookup
from reviewloom.operators.ids import encode_labels

# One review of the FILTER variant; of the FULL variant only the pictures differ.
FILTER_RECORD = (
    "struct<business_id:string,user_id:string,rating:int,review_text:string,"
    "pics:array<string>>"
)
FULL_RECORD = (
    "struct<business_id:string,user_id:string,rating:int,review_text:string,"
    "pics:array<struct<id:string>>>"
)
FILTER_FILE = (
    f"struct<train:array<{FILTER_RECORD}>,val:array<{FILTER_RECORD}>,"
    f"test:array<{FILTER_RECORD}>>"
)
FULL_FILE = f"array<{FULL_RECORD}>"

# Names and types of reviews with integer ids.
REVIEWS_SCHEMA = T.StructType(
    [
        T.StructField("business_id", T.IntegerType(), True),
        T.StructField("user_id", T.IntegerType(), True),
        T.StructField("rating", T.IntegerType(), True),
        T.StructField("review_text", T.StringType(), True),
    ]
)


# The lists of a printed file.
LISTS = ("train", "val", "test")

# What may stand between two records: brackets, commas, and names of lists.
_BETWEEN = re.compile(r"(?:[\s\[\]{},:]|" + "|".join(f"'{name}'" for name in LISTS) + r")*")


def printed_records(piece: str) -> list[dict]:
    """The records of a piece of a printed file that starts inside a list of them.

    The piece ends in what stands before the next record or after the last one. Records
    are parsed as literals, never run as code; anything else is an error.
    """
    end = len(piece)
    for _ in range(3):
        end = piece.rfind("}", 0, end)
        if end < 0:
            break
        if not _BETWEEN.fullmatch(piece, end + 1):
            break
        try:
            found = ast.literal_eval(piece[: end + 1])
        except (SyntaxError, ValueError):
            continue
        return list(found) if isinstance(found, tuple) else [found]
    raise ValueError(f"no printed record: {piece[:80]!r}")


def _pieces_to_json(start: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            records = [
                json.dumps(record)
                for piece in batch["value"]
                # What stands before the first record of a file.
                if not _BETWEEN.fullmatch(piece)
                for record in printed_records(start + piece)
            ]
            yield pd.DataFrame({"value": records}, dtype=object)

    return run


def _first_key(spark: SparkSession, path: str) -> str | None:
    """The key with which the first printed record starts."""
    # A limit reads the head of the file only; names of lists may come before the first record.
    heads = spark.read.text(path, lineSep="{'").limit(2 + len(LISTS)).collect()
    keys = [re.match(r"(\w+)'\s*:", row["value"]) for row in heads]
    return next((key[1] for key in keys if key and key[1] not in LISTS), None)


# What is left of a text within double quotes, and what stands outside of them.
_REST_OF_TEXT = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)
_NO_OPEN_TEXT = re.compile(r"""(?:[^'"]|'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+")*+""", re.DOTALL)


def ends_in_text(piece: str, in_text: bool) -> bool:
    """Whether a piece ends within double quotes, if it begins within (or outside of) them.

    Only there can a text hold the start of a record, whose single quotes would have to be
    escaped elsewhere.
    """
    at = 0
    if in_text:
        rest = _REST_OF_TEXT.match(piece)
        if not rest:
            return True
        at = rest.end()
    at = _NO_OPEN_TEXT.match(piece, at).end()
    return piece[at : at + 1] == '"'


_PIECES = "file string, block bigint, slot bigint, value string, " + ", ".join(
    f"{name}_{state} {kind}" for name, kind in (("last", "bigint"), ("after", "int")) for state in (0, 1)
)


def _mark_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For both states in which a block may begin: the piece that starts the record so far,
    and the state after each piece. Pieces come in the order of their block."""
    block, after, last = None, [0, 1], [None, None]
    for batch in batches:
        marks = []
        for row in batch.itertuples(index=False):
            if (row.file, row.block) != block:
                block, after, last = (row.file, row.block), [0, 1], [None, None]
            last = [row.slot if state == 0 else old for state, old in zip(after, last)]
            found = [int(ends_in_text(row.value, bool(state))) for state in set(after)]
            after = [dict(zip(set(after), found))[state] for state in after]
            marks.append((*last, *after))
        names = ["last_0", "last_1", "after_0", "after_1"]
        columns = pd.DataFrame(marks, columns=names, index=batch.index, dtype=object)
        yield pd.concat([batch, columns], axis=1)


_BLOCKS = "file string, block bigint, open int, carried_block bigint, carried_slot bigint"


def _open_blocks(blocks: pd.DataFrame) -> pd.DataFrame:
    """In which state each block of a file begins, and the record that is carried into it."""
    state, carried, rows = 0, (None, None), []
    for row in blocks.sort_values("block").to_dict("records"):
        rows.append((row["file"], row["block"], state, *carried))
        last = row[f"last_{state}"]
        carried = carried if pd.isna(last) else (row["block"], int(last))
        state = row[f"after_{state}"]
    return pd.DataFrame(rows, columns=["file", "block", "open", "carried_block", "carried_slot"], dtype=object)


def _whole_pieces(spark: SparkSession, path: str, start: str) -> DataFrame:
    """The text after each start of a record up to the next one, as ``value``.

    A start within a text is none: its piece goes back to the one before. The files are cut
    at all starts, by many tasks; each block says how it ends for both states in which it
    may begin, and these answers are put together block after block.
    """
    pieces = spark.read.text(path, lineSep=start).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("slot"),
        "value",
    )
    marked = stored(pieces.mapInPandas(_mark_pieces, _PIECES), "printed-pieces")
    ends = marked.groupBy("file", "block").agg(
        *[F.max_by(name, "slot").alias(name) for name in ("last_0", "last_1", "after_0", "after_1")]
    )
    # A row for each block of a file.
    places = stored_lookup(ends.groupBy("file").applyInPandas(_open_blocks, _BLOCKS), "printed-blocks")
    at_0 = F.col("open") == 0
    own = F.when(at_0, F.col("last_0")).otherwise(F.col("last_1"))
    carried = F.struct(F.col("carried_block").alias("block"), F.col("carried_slot").alias("slot"))
    placed = marked.join(places, ["file", "block"]).select(
        "file", "block", "slot", "value",
        F.when(own.isNotNull(), F.struct("block", own.alias("slot"))).otherwise(carried).alias("start"),
        F.when(at_0, F.col("after_0")).otherwise(F.col("after_1")).alias("after"),
    )
    alone = F.col("start").eqNullSafe(F.struct("block", "slot")) & (F.col("after") == 0)
    parts = F.sort_array(F.collect_list(F.struct("block", "slot", "value")))
    joined = placed.where(~alone).groupBy("file", "start").agg(
        F.array_join(F.transform(parts, lambda part: part["value"]), start).alias("value")
    )
    return placed.where(alone).select("value").unionByName(joined.select("value"))


def literal_to_json_lines(
    spark: SparkSession, path: str, out: str, first_key: str | None = None
) -> None:
    """Rewrite printed Python lists or dicts of records as one JSON record per line.

    However long a printed line is, it is read by many tasks: the start of a record,
    ``{'first_key': ``, serves as the line separator. Records that start with another key
    are found in the piece of the one before. Texts may hold anything, the separator
    too; all that is no literal is an error. Without ``first_key`` the key of the first
    record is taken; a file without records gives no lines.
    """
    first_key = first_key or _first_key(spark, path)
    start = f"{{'{first_key}': "
    found = _whole_pieces(spark, path, start).mapInPandas(_pieces_to_json(start), "value string")
    found.write.mode("overwrite").text(out)


def read_review_lines(spark: SparkSession, path: str, variant: str = "FILTER") -> DataFrame:
    """JSON lines to rows with the five review fields; missing keys are null.

    A line that is no such record is an error, not a row of nulls; blank lines are none.
    """
    record = FULL_RECORD if variant == "FULL" else FILTER_RECORD
    lines = spark.read.text(path).where(F.trim("value") != "")
    records = lines.select(F.from_json("value", record, {"mode": "FAILFAST"}).alias("record"))
    return records.select(*review_fields(F.col("record"), variant))


def read_review_file(spark: SparkSession, path: str, variant: str = "FILTER") -> DataFrame:
    """A file that holds one JSON value: lists named train, val, test, or one flat list."""
    values = spark.read.text(path, wholetext=True)
    if variant == "FULL":
        records = F.from_json("value", FULL_FILE)
    else:
        lists = F.from_json("value", FILTER_FILE)
        records = F.concat(lists["train"], lists["val"], lists["test"])
    exploded = values.select(F.explode(records).alias("record"))
    return exploded.select(*review_fields(F.col("record"), variant))


def review_fields(record: Column, variant: str = "FILTER") -> list[Column]:
    """The fields of a record as columns; pictures of the FULL variant become their ids."""
    pics = record["pics"]
    if variant == "FULL":
        pics = F.transform(pics, lambda pic: pic["id"])
    names = ("business_id", "user_id", "rating", "review_text")
    return [record[name].alias(name) for name in names] + [pics.alias("pics")]


def with_picture_words(reviews: DataFrame, tags_per_picture: str, top: int = 10) -> DataFrame:
    """Append the first tags of each picture to the text of its review."""
    words = picture_words(F.col(tags_per_picture), top)
    return reviews.withColumn("review_text", append_picture_words(F.col("review_text"), words))


def typed_reviews(reviews: DataFrame) -> DataFrame:
    """The four review columns in their types, missing texts filled."""
    return reviews.select(
        F.col("business_id").cast("int"),
        F.col("user_id").cast("int"),
        F.col("rating").cast("int"),
        fill_missing_text(F.col("review_text")).alias("review_text"),
    ).to(REVIEWS_SCHEMA)


def encoded_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews whose business and user ids are dense integers."""
    chosen = reviews.select("business_id", "user_id", "rating", "review_text")
    return encode_labels(chosen, "business_id", "user_id")
