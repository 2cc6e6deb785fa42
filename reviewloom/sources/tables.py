"""Review, recipe and vector tables made from the tables in a parquet folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.vectors import as_doubles
from reviewloom.operators.durable import lookup

# The embeddings table holds vectors of this length.
VECTOR_SIZE = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a scan that has fewer partitions than there are cores, over all cores.

    Cutting texts into words is worth a shuffle of them only while cores stand idle; a
    table of many files keeps its own partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def reviews_text(spark: SparkSession, folder: str) -> DataFrame:
    """Long texts in several languages, with some users and businesses seen only once."""
    texts = documents(spark, folder)
    # The texts stay where they are while the labels are small beside them.
    labels = lookup(table(spark, folder, "labels").select("doc_id", "quality", "toxic"))
    doc = F.col("doc_id")
    rating = F.lit(1) + 3 * F.col("quality") + (F.lit(1) - F.col("toxic"))
    solo = F.concat(F.lit("solo"), doc.cast("string"))
    return texts.join(labels, "doc_id", "left").select(
        doc.alias("review_id"),
        F.when(doc % 10 == 0, doc + 1_000_000).otherwise(doc * 7919 % 61).alias("user_id"),
        F.when(doc % 20 == 0, solo).otherwise(F.col("source")).alias("business_id"),
        F.when(F.col("quality").isNotNull(), rating).alias("rating"),
        F.col("text").alias("review_text"),
    )


def reviews_bulk(spark: SparkSession, folder: str) -> DataFrame:
    """Many short reviews: one per order line, by its customer, of its supplier."""
    orders = table(spark, folder, "orders")
    parts = table(spark, folder, "part")
    lines = table(spark, folder, "lineitem")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
        .select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_suppkey").alias("business_id"),
            F.col("l_quantity").cast("int").alias("rating"),
            F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("review_text"),
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_extendedprice",
        )
    )


def recipes(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as recipes: a name and two printed lists."""
    name, kind, brand = F.col("p_name"), F.lower("p_type"), F.lower("p_brand")

    def printed(first, second):
        return F.concat(F.lit("['"), first, F.lit("', '"), second, F.lit("']"))

    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("recipe_id"),
        name.alias("name"),
        printed(F.replace(name, F.lit(" "), F.lit("', '")), kind).alias("ingredients"),
        printed(brand, kind).alias("tags"),
    )


def word_vectors(spark: SparkSession, folder: str, vocabulary: DataFrame) -> DataFrame:
    """The words of a vocabulary with a vector each, given out in turn.

    Not written: one vector stands for many words, and the copies would take more room than the texts.
    """
    embeddings = table(spark, folder, "embeddings")
    number = embeddings.agg(F.count("*")).scalar()
    turn = vocabulary.select("word", "idx").withColumn("vec_id", F.col("idx") % number)
    vectors = embeddings.select("vec_id", as_doubles(F.col("embedding")).alias("vec"))
    return turn.join(lookup(vectors), "vec_id").select("word", "vec")
