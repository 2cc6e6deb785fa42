"""A corpus made ready for training: five stages, each over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import line_dedup, mixing, packing, shingles, simhash, toxicity
from reviewloom.llm.common import read, ship
from reviewloom.llm.queries import tokenizer_files
from reviewloom.operators.durable import shared_folder

# Scores need Python and the near-copies a metric tree, so SQL cannot express the stages.
ORACLE_SQL = None


def _like_documents(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of the documents; their count of characters follows the text."""
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.length("text").cast(kind))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned scores reject go."""
    ship(spark)
    labels = read(spark, sf_dir, "labels")
    known = labels.where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.without_toxic(docs, known)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one of them."""
    return _like_documents(line_dedup.drop_shared_lines(docs), docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays.

    Fingerprints link copies that hardly differ; as they see few copies with more edits, texts
    that share 0.8 or more of their runs of five words are linked as well.
    """
    ship(spark)
    rows = simhash.numbered(docs)
    near = simhash.near_copies(rows, simhash.ROW)
    return simhash.first_of_each(rows, shingles.linked(rows, simhash.ROW, given=near))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target of their source asks for."""
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, laid into sequences."""
    ship(spark)
    return packing.packed(docs, **tokenizer_files())


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_shared_lines),
    ("near_copies", without_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
