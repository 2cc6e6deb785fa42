"""Queries on ids, ratings, interactions, scores, and the clean-up of reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.operators import ids, stats, words
from reviewloom.operators.durable import stored
from reviewloom.plans import sql as S
from reviewloom.plans.queries_text import document_vocabulary
from reviewloom.plans.registry import query, rounded
from reviewloom.sources import reviews as reviews_source
from reviewloom.sources import tables

_BULK = {"reviews": S.REVIEWS_BULK}
_TEXT = {"reviews": S.REVIEWS_TEXT}
_BULK_KEYS = "user_id, business_id, rating, l_orderkey, l_linenumber, l_partkey, l_extendedprice"


@query(
    "label_encode",
    S.with_parts(
        _TEXT,
        """
SELECT review_id, dense_rank() OVER (ORDER BY user_id) - 1 AS user_id,
       dense_rank() OVER (ORDER BY business_id) - 1 AS business_id
FROM reviews""",
    ),
)
def label_encode(spark, folder):
    reviews = tables.reviews_text(spark, folder).select("review_id", "user_id", "business_id")
    return ids.encode_labels(reviews, "user_id", "business_id")


@query(
    "label_encode_bulk",
    S.with_parts(
        _BULK,
        """
SELECT l_orderkey, l_linenumber, l_partkey, rating,
       dense_rank() OVER (ORDER BY user_id) - 1 AS user_id,
       dense_rank() OVER (ORDER BY review_text) - 1 AS review_text
FROM reviews""",
    ),
)
def label_encode_bulk(spark, folder):
    reviews = tables.reviews_bulk(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_partkey", "rating", "user_id", "review_text"
    )
    return ids.encode_labels(reviews, "user_id", "review_text")


@query(
    "row_ids",
    S.with_parts(
        _BULK,
        f"""
SELECT {_BULK_KEYS}, review_text,
       row_number() OVER (ORDER BY user_id, business_id, rating, review_text, l_orderkey,
         l_linenumber, l_partkey, l_extendedprice) - 1 + 1000 AS review_id
FROM reviews""",
    ),
)
def row_ids(spark, folder):
    reviews = tables.reviews_bulk(spark, folder)
    return ids.add_review_ids(reviews, 1000, reviews.columns)


@query(
    "typed_reviews",
    S.with_parts(
        _TEXT,
        """
SELECT right(business_id, 1)::int AS business_id, user_id::int AS user_id,
       rating::int AS rating, coalesce(CASE WHEN review_id % 50 <> 0 THEN review_text END, '_')
         AS review_text
FROM reviews""",
    ),
)
def typed_reviews(spark, folder):
    reviews = tables.reviews_text(spark, folder)
    holes = reviews.withColumn("business_id", F.expr("right(business_id, 1)")).withColumn(
        "review_text", F.when(F.col("review_id") % 50 != 0, F.col("review_text"))
    )
    return reviews_source.typed_reviews(holes)


@query(
    "record_fields",
    S.with_parts(
        _TEXT,
        """
SELECT business_id, user_id::varchar AS user_id, rating::int AS rating, review_text,
       len(string_split(business_id, 'o'))::bigint AS pics
FROM reviews
UNION ALL
SELECT c_mktsegment, c_custkey::varchar, NULL, NULL, NULL FROM customer""",
    ),
)
def record_fields(spark, folder):
    """Records with missing keys, as JSON text, from two sources."""
    full = tables.reviews_text(spark, folder).select(
        "business_id",
        F.col("user_id").cast("string").alias("user_id"),
        "rating",
        "review_text",
        F.transform(F.split("business_id", "o"), lambda p: F.struct(p.alias("id"))).alias("pics"),
    )
    partial = tables.table(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("business_id"),
        F.col("c_custkey").cast("string").alias("user_id"),
    )

    def as_json(rows):
        return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))

    lines = as_json(full).unionByName(as_json(partial))
    records = lines.select(F.from_json("value", reviews_source.FULL_RECORD).alias("record"))
    rows = records.select(*reviews_source.review_fields(F.col("record"), "FULL"))
    counted = F.when(F.col("pics").isNotNull(), F.size("pics").cast("bigint"))
    return rows.withColumn("pics", counted)


@query(
    "zscore",
    S.with_parts(
        _BULK,
        f"""
SELECT l_orderkey, l_linenumber, l_partkey, business_id, rating,
       {S.r6('''CASE WHEN min(rating) OVER w = max(rating) OVER w THEN 0.0
            ELSE (rating - avg(rating) OVER w) / stddev_pop(rating) OVER w END''')} AS z
FROM reviews WINDOW w AS (PARTITION BY business_id)""",
    ),
)
def zscore(spark, folder):
    reviews = tables.reviews_bulk(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_partkey", "business_id", "rating"
    )
    return stats.group_z_scores(reviews, "business_id", "rating").withColumn("z", rounded("z"))


def _ratio_sql(divisor: str) -> str:
    return S.with_parts(
        _TEXT,
        f"""
SELECT review_id, user_id, rating,
       {S.r6(f'''coalesce(CASE WHEN min(rating) OVER w < max(rating) OVER w
            THEN avg(rating) OVER w / (stddev_pop(rating) OVER w{divisor}) END, 0.0)''')} AS ratio
FROM reviews WINDOW w AS (PARTITION BY user_id)""",
    )


@query("rating_ratio", _ratio_sql(""))
def rating_ratio(spark, folder):
    reviews = tables.reviews_text(spark, folder).select("review_id", "user_id", "rating")
    ratios = stats.group_mean_ratios(reviews, "user_id", "rating")
    return ratios.withColumn("ratio", rounded("ratio"))


@query(
    "rating_ratio_all_rows",
    _ratio_sql(" * sqrt(count(rating) OVER w / count(*) OVER w)"),
)
def rating_ratio_all_rows(spark, folder):
    reviews = tables.reviews_text(spark, folder).select("review_id", "user_id", "rating")
    ratios = stats.group_mean_ratios(reviews, "user_id", "rating", all_rows=True)
    return ratios.withColumn("ratio", rounded("ratio"))


_SIZES = _BULK | {
    "sizes": """
SELECT business_id, count(DISTINCT user_id) AS size FROM reviews GROUP BY business_id"""
}


@query("interaction_sets", S.with_parts(_BULK, "SELECT DISTINCT business_id, user_id FROM reviews"))
def interaction_sets(spark, folder):
    return stats.distinct_pairs(tables.reviews_bulk(spark, folder), "business_id", "user_id")


@query(
    "interaction_metrics",
    S.with_parts(
        _SIZES,
        f"""
SELECT count(*) AS entities, max(size) AS max_size, median(size) AS median_size,
       {S.r6('avg(size)')} AS mean_size
FROM sizes""",
    ),
)
def interaction_metrics(spark, folder):
    reviews = tables.reviews_bulk(spark, folder)
    metrics = stats.interaction_metrics(reviews, "business_id", "user_id")
    return metrics.withColumn("mean_size", rounded("mean_size"))


@query(
    "interaction_histogram",
    S.with_parts(
        _SIZES,
        """
SELECT least(((size - low) * 10) // (high - low), 9)::int AS bin, count(*) AS entities
FROM sizes, (SELECT min(size) AS low, max(size) AS high FROM sizes) GROUP BY 1""",
    ),
)
def interaction_histogram(spark, folder):
    reviews = tables.reviews_bulk(spark, folder)
    return stats.interaction_histogram(reviews, "business_id", "user_id")


def scored_lines(spark, folder):
    """Order lines with a truth and a score."""
    price = F.col("l_extendedprice")
    return tables.table(spark, folder, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("truth"),
        (price / (price + 20000.0)).alias("score"),
    )


_SCORED = {
    "scored": """
SELECT (l_returnflag = 'R')::int AS truth,
       l_extendedprice / (l_extendedprice + 20000.0::double) AS score FROM lineitem"""
}


@query(
    "confusion",
    S.with_parts(
        _SCORED,
        f"""
SELECT g.truth, p.predicted, count(s.score) AS rows,
       {S.r6('''coalesce(count(s.score) / nullif(sum(count(s.score))
              OVER (PARTITION BY g.truth), 0), 0.0)''')} AS share
FROM (SELECT unnest([0, 1]) AS truth) g CROSS JOIN (SELECT unnest([0, 1]) AS predicted) p
LEFT JOIN scored s ON s.truth = g.truth AND (s.score >= 0.5)::int = p.predicted
GROUP BY g.truth, p.predicted""",
    ),
)
def confusion(spark, folder):
    predicted = stats.threshold(F.col("score")).alias("predicted")
    rows = scored_lines(spark, folder).select("truth", predicted)
    matrix = stats.confusion_matrix(rows, "truth", "predicted")
    return matrix.withColumn("share", rounded("share"))


@query(
    "auc",
    S.with_parts(
        _SCORED
        | {
            "ranked": """
SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::double
         AS place FROM scored"""
        },
        f"""
SELECT {S.r6('''(sum(place) FILTER (truth = 1) - p * (p + 1) / 2.0::double) / (p * n)''')} AS auc
FROM ranked, (SELECT sum(truth)::double AS p, sum(1 - truth)::double AS n FROM scored)
GROUP BY p, n""",
    ),
)
def auc(spark, folder):
    area = stats.area_under_roc(scored_lines(spark, folder), "truth", "score")
    return area.withColumn("auc", rounded("auc"))


def usable_review_words(spark, folder):
    """The usable words of ``reviews_text``, one row per review and word with their number."""
    vocab = document_vocabulary(spark, folder)
    reviews = tables.reviews_text(spark, folder).drop("rating")
    return words.review_words(reviews, vocab, by_word=True)


@query(
    "review_words",
    S.with_parts(S.occurrences(), "SELECT user_id, business_id, review_id, word, n FROM counts0"),
)
def review_words(spark, folder):
    return words.review_word_counts(usable_review_words(spark, folder))


@query(
    "review_word_rows",
    S.with_parts(S.occurrences(), "SELECT user_id, business_id, review_id, word FROM occ"),
)
def review_word_rows(spark, folder):
    """Ids and words apart, then joined again on the review."""
    vocab = document_vocabulary(spark, folder)
    reviews = tables.reviews_text(spark, folder)
    id_rows, texts = ids.split_ids_and_text(reviews)
    return words.attach_ids(id_rows, words.review_words(texts, vocab)).select(
        "user_id", "business_id", "review_id", "word"
    )


@query(
    "surviving_reviews",
    S.with_parts(
        S.occurrences(),
        """
SELECT review_id, user_id, business_id, rating FROM reviews
WHERE review_id IN (SELECT review_id FROM occ)""",
    ),
)
def surviving_reviews(spark, folder):
    reviews = tables.reviews_text(spark, folder).select(
        "review_id", "user_id", "business_id", "rating"
    )
    return words.reviews_with_words(reviews, usable_review_words(spark, folder))


@query(
    "double_singletons", S.with_parts(S.kept(), "SELECT user_id, business_id, review_id FROM ids")
)
def double_singletons(spark, folder):
    pairs = words.review_pairs(usable_review_words(spark, folder))
    return words.drop_double_singletons(stored(pairs, "pairs"))


@query(
    "values_seen_once",
    S.with_parts(
        _BULK,
        """
SELECT l_orderkey AS user_id, min(l_partkey) AS review_id FROM reviews
GROUP BY l_orderkey HAVING count(*) = 1""",
    ),
)
def values_seen_once(spark, folder):
    reviews = tables.reviews_bulk(spark, folder).select(
        F.col("l_orderkey").alias("user_id"), F.col("l_partkey").alias("review_id")
    )
    return words.values_seen_once(reviews, "user_id")


@query(
    "pair_table",
    S.with_parts(S.occurrences(), "SELECT DISTINCT user_id, business_id, review_id FROM occ"),
)
def pair_table(spark, folder):
    return words.review_pairs(usable_review_words(spark, folder))
