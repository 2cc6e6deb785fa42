"""Lines that many documents share stay in one of them only.

Lines are exploded with their place, normalised and hashed; documents are counted per hash;
the places to drop go back to each document, which is put together again from the runs of
lines between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import SPACE, UPPER, same, text_of
from reviewloom.operators.durable import stored


def line_key(line: Column) -> Column:
    """A line without white space at its ends, with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, UPPER.lower())


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    key = line_key(F.col("line"))
    return (
        docs.select("id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .where(F.length(F.btrim("line", F.lit(SPACE))) >= min_chars)
        # 128 bits: 64 are too few for the lines of a large corpus.
        .select("id", "text_hash", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))
    )


def _kept_lines(lines: Column, dropped: Column) -> Column:
    """The runs of lines between dropped places (sorted), in time linear in the lines."""
    ends = F.concat(dropped, F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda place: place + 1))
    runs = F.zip_with(starts, ends, lambda start, end: F.slice(lines, start + 1, end - start))
    return F.flatten(runs)


def drop_shared_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
) -> DataFrame:
    """The documents without lines that at least ``min_docs`` documents hold.

    Lines are compared by :func:`line_key`; keys under ``min_chars`` code points stay. A
    dropped line stays in the document with the largest key that holds it, as often as it
    stands there. Adds ``n_lines`` (before) and ``n_dropped``; ``text`` has the kept lines.

    Edges: a null text is one empty line and comes back empty. Rows that share a key count
    as one document, and each is cleaned. Rows with a null key are cleaned but add nothing
    to the count of documents and never keep a shared line. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("id"), text_of(F.col(text)).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    lines = stored(_lines(rows, min_chars), "lines")
    # Once per document first, then per line: both steps add up before they shuffle.
    per_doc = lines.select("h1", "h2", "id").distinct()
    shared = (
        per_doc.groupBy("h1", "h2")
        .agg(F.count("id").alias("n_docs"), F.max("id").alias("holder"))
        .where(F.col("n_docs") >= min_docs)
    )
    # Written, so that the join has a shuffle of its own and a frequent line can be split.
    shared = stored(shared.select("h1", "h2", "holder"), "shared-lines")
    places = (
        lines.join(shared, ["h1", "h2"])
        .where(~same(F.col("id"), F.col("holder")))
        .groupBy("id", "text_hash")
        # A row's places are at most its lines; repeated rows bring them twice.
        .agg(F.sort_array(F.collect_set("pos")).alias("places"))
        .select(F.col("id").alias("_id"), F.col("text_hash").alias("_text_hash"), "places")
    )
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"),
        F.col(key).alias("id"),
        F.xxhash64(text_of(F.col(text))).alias("text_hash"),
    )
    joined = packed.join(
        places,
        same(F.col("id"), F.col("_id")) & (F.col("text_hash") == F.col("_text_hash")),
        "left",
    )
    split = F.split(text_of(F.col(f"row.`{text}`")), "\n")
    none = F.array().cast("array<int>")
    return joined.select("row", split.alias("lines"), F.coalesce("places", none).alias("places")).select(
        *[
            F.array_join(_kept_lines(F.col("lines"), F.col("places")), "\n").alias(c)
            if c == text
            else F.col(f"row.`{c}`").alias(c)
            for c in own
        ],
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size("places").cast("bigint").alias("n_dropped"),
    )
