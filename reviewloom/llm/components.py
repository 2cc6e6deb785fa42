"""Connected components of a table of links, by turns of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.durable import stored


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    # Written, so that the join back has a shuffle of its own and a hub can be split.
    found = pairs.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n"))
    return stored(found, "least-neighbours")


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) for every linked node.

    Each turn hangs the larger neighbours of every node on its smallest one, then the
    node itself and its smaller neighbours. The turns end when every node with a smaller
    neighbour has that one alone, for then all hang on their root; links that are stars
    from the start take no turn. The number of turns grows with the logarithm of the longest
    chain. Links stay in tables; the driver sees whether such a node is left. Rows with a
    null end or with equal ends add nothing; an empty table gives no rows.
    """
    ends = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    edges = stored(
        ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = _least_neighbour(both)
        if around.where("least < u AND n > 1").isEmpty():
            break
        large = both.join(around.drop("n"), "u").where(F.col("v") > F.col("u"))
        # As many rows as links; equal ones go with the small stars.
        large = stored(large.select(F.col("v").alias("u"), F.least("u", "least").alias("v")), "large-stars")
        small = large.join(_least_neighbour(large).drop("n"), "u")
        hung = small.where(F.col("v") > F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
        kept = small.select("u", F.col("least").alias("v"))
        edges = stored(hung.unionByName(kept).distinct(), "small-stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
