"""Queries that train a model; their rows are checked, not their values."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from reviewloom.functions.vectors import as_doubles, length
from reviewloom.operators import learning, sampling, stats
from reviewloom.operators.durable import stored
from reviewloom.operators.entity_vectors import ENTITIES, entity_means, review_sums
from reviewloom.operators.groups import attach_groups, group_keywords
from reviewloom.operators.tfidf import keywords_per_label
from reviewloom.operators.vocabulary import spell_words
from reviewloom.plans import sql as S
from reviewloom.plans.modelling import baseline, deep_learning, entity_groups, evaluate
from reviewloom.plans.preparation import Settings, prepare
from reviewloom.plans.queries_vectors import MODES, TOP, _inputs, _kept, _review_sums, group_parts
from reviewloom.plans.registry import query, rounded
from reviewloom.sources import tables
from reviewloom.sources.recipes import recipe_word_lists


def _prepared(spark, folder):
    settings = Settings(S.SIZE)
    return prepare(*_inputs(spark, folder), settings), settings


@query("lr_scores")
def lr_scores(spark, folder):
    """Validation rows with the score of the logistic regression."""
    prepared, _ = _prepared(spark, folder)
    return baseline(prepared).select("key", "user_id", "business_id", "y", "score", "predicted")


@query("lr_auc")
def lr_auc(spark, folder):
    prepared, _ = _prepared(spark, folder)
    return stats.area_under_roc(stored(baseline(prepared), "scores"), "y", "score")


@query("mlp_scores")
def mlp_scores(spark, folder):
    """Validation rows with the score of the neural network."""
    prepared, settings = _prepared(spark, folder)
    scored = deep_learning(prepared, settings)
    return scored.select("key", "user_id", "business_id", "y", "score", "predicted")


@query("lr_confusion")
def lr_confusion(spark, folder):
    prepared, _ = _prepared(spark, folder)
    return evaluate(baseline(prepared)).confusion


@query(
    "pca_variance",
    S.with_parts(
        {
            "long": f"""
SELECT vec_id, unnest(range({S.SIZE})) AS dim, unnest(embedding)::double AS x FROM embeddings""",
            "covered": """
SELECT a.dim AS i, b.dim AS j, covar_samp(a.x, b.x) AS c
FROM long a JOIN long b ON a.vec_id = b.vec_id GROUP BY ALL""",
        },
        f"""
SELECT {S.SIZE} AS components, 1.0::double AS shares,
       {S.r6('sum(c * c) / power(sum(c) FILTER (i = j), 2)')} AS squared_shares
FROM covered""",
    ),
)
def pca_variance(spark, folder):
    """The shares of variance of all components, and their squares, added up.

    The squares belong to the squares of all covariances.
    """
    rows = tables.table(spark, folder, "embeddings")
    rows = learning.with_features(rows, as_doubles(F.col("embedding")))
    shares = learning.explained_variance(learning.fit_components(rows, S.SIZE))
    listed = spark.createDataFrame([(share,) for share in shares], "share double")
    return listed.agg(
        F.count("*").cast("int").alias("components"),
        rounded(F.sum("share")).alias("shares"),
        rounded(F.sum(F.col("share") * F.col("share"))).alias("squared_shares"),
    )


# How many groups of each side the keyword report asks for.
GROUPS = {"user": 20, "business": 10}


def _group_sql(entity):
    """``<entity>_grp``: id (as text) and grp."""
    key = f"{entity}_id"
    return (
        S.entity_means(entity)
        | {f"{entity}_points": f"SELECT {key}::varchar AS id, dim, value AS x FROM {entity}_mean"}
        | S.lloyd(f"{entity}_grp", f"{entity}_points", GROUPS[entity])
    )


def _grouped(sums, entity):
    means = stored(entity_means(sums, entity), "means")
    found = entity_groups(means, entity, GROUPS[entity], S.SIZE, hashed=sampling.spread_hash)
    return stored(found, "groups")


@query(
    "kmeans_sizes",
    S.with_parts(
        S.review_sums("tfidf") | _group_sql("user") | _group_sql("business"),
        """
SELECT 'user' AS entity, grp::int AS "group", count(*) AS members FROM user_grp GROUP BY grp
UNION ALL
SELECT 'business', grp::int, count(*) FROM business_grp GROUP BY grp""",
    ),
)
def kmeans_sizes(spark, folder):
    sums = _review_sums(spark, folder, "tfidf")

    def sizes(entity):
        counted = _grouped(sums, entity).groupBy("group")
        return counted.agg(F.count("*").alias("members")).select(
            F.lit(entity).alias("entity"), "group", "members"
        )

    return sizes("user").unionByName(sizes("business"))


def _counts_and_groups(spark, folder, entity):
    counts, vectors, vocab = _kept(spark, folder)
    counts = stored(counts, "kept-counts")
    sums = review_sums(counts, vectors, S.SIZE, MODES["tfidf"], vocab, [entity])
    return counts, vocab, _grouped(sums, entity)


def _keyword_sql(entity):
    given = group_parts(entity)
    found = {"groups": f"SELECT r.{entity}_id, g.grp FROM (SELECT DISTINCT {entity}_id FROM counts) r JOIN {entity}_grp g ON r.{entity}_id::varchar = g.id"}
    rest = {name: part for name, part in given.items() if name not in {*S.kept(), "entities", "groups"}}
    return S.review_sums("tfidf") | _group_sql(entity) | found | rest


@query(
    "kmeans_keywords",
    S.with_parts(
        _keyword_sql("business") | {"top": TOP},
        """
SELECT arg_position, arg_label, list(word ORDER BY rank) AS words
FROM top GROUP BY arg_position, arg_label""",
    ),
)
def kmeans_keywords(spark, folder):
    """The telling words of groups found by k-means, one list per group."""
    counts, vocab, grouped = _counts_and_groups(spark, folder, "business")
    codes = vocab.select(F.col("idx").alias("word"))
    top = group_keywords(counts, grouped, codes, "business")
    return keywords_per_label(spell_words(top, vocab))


@query(
    "grouped_words",
    S.with_parts(
        S.review_sums("tfidf") | _group_sql("user"),
        """
SELECT c.user_id, c.word, c.n, g.grp::int AS "group"
FROM counts c JOIN user_grp g ON c.user_id::varchar = g.id""",
    ),
)
def grouped_words(spark, folder):
    """Words of each user with the user's group."""
    counts, vocab, grouped = _counts_and_groups(spark, folder, "user")
    words = spell_words(counts.select("user_id", "word", "n"), vocab)
    return attach_groups(words, grouped, "user")


@query("pca_points")
def pca_points(spark, folder):
    """Users and businesses on the first two principal components."""
    sums = _review_sums(spark, folder, "tfidf")

    def points(entity):
        rows = learning.with_features(
            stored(entity_means(sums, entity), "means"), F.col(f"{entity}_vec")
        )
        placed = learning.fit_components(rows, 2).transform(rows)
        both = vector_to_array("components")
        return placed.select(
            F.lit(entity).alias("entity"),
            F.col(f"{entity}_id").cast("string").alias("id"),
            F.get(both, F.lit(0)).alias("x"),
            F.get(both, F.lit(1)).alias("y"),
        )

    return points(ENTITIES[0]).unionByName(points(ENTITIES[1]))


@query("word2vec_vocab")
def word2vec_vocab(spark, folder):
    """Words with the length of the vector that training on recipes gave them."""
    lists = recipe_word_lists(tables.recipes(spark, folder), ["ingredients", "name"])
    model = learning.train_word_vectors(lists, "words", size=100, window=5)
    vectors = learning.model_vectors(model)
    return vectors.select("word", length(F.col("vec")).alias("length"))
