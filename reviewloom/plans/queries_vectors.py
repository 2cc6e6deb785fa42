"""Queries on entity vectors, pairs, sampling and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.functions import vectors as V
from reviewloom.operators import entity_vectors as E
from reviewloom.operators import groups, ids, sampling, similarity
from reviewloom.operators.durable import stored
from reviewloom.operators.tfidf import keywords_per_label
from reviewloom.operators.vocabulary import code_words, spell_words
from reviewloom.plans import sql as S
from reviewloom.plans.modelling import split_training_set
from reviewloom.plans.preparation import Settings, kept_word_counts, prepare, training_set
from reviewloom.plans.queries_text import document_vocabulary, word_label_parts
from reviewloom.plans.registry import long_vectors, query, rounded
from reviewloom.sources import tables

MODES = {
    "plain": E.Weighting(with_tfidf=False),
    "tfidf": E.Weighting(),
    "weighted": E.Weighting(weighted_vectors=True),
}


def _inputs(spark, folder):
    vocab = document_vocabulary(spark, folder)
    vectors = tables.word_vectors(spark, folder, vocab)
    return tables.reviews_text(spark, folder), vocab, vectors


def _kept(spark, folder):
    """Word counts, the words' vectors, and the vocabulary."""
    reviews, vocab, vectors = _inputs(spark, folder)
    return kept_word_counts(reviews, vocab, vectors), vectors, vocab


def _review_sums(spark, folder, mode, sides=E.ENTITIES):
    counts, vectors, vocab = _kept(spark, folder)
    return E.review_sums(counts, vectors, S.SIZE, MODES[mode], vocab, sides)


def _register_word_weights(entity):
    key = f"{entity}_id"

    @query(
        f"{entity}_word_weights",
        S.with_parts(
            S.kept() | S.entity_weights(entity),
            f"SELECT {key}, word, tf, df, {S.r6('weight')} AS weight FROM {entity}_w",
        ),
    )
    def word_weights(spark, folder):
        counts, _, vocab = _kept(spark, folder)
        weights = spell_words(E.entity_word_weights(counts, entity), vocab, counts.count())
        return weights.withColumn("weight", rounded("weight"))


def _register_word_level(entity, with_tfidf):
    key = f"{entity}_id"
    weight = "w.weight" if with_tfidf else "1.0::double"
    join = (
        f"JOIN {entity}_w w ON c.{key} = w.{key} AND c.word = w.word" if with_tfidf else ""
    )

    @query(
        f"word_level_{entity}" + ("" if with_tfidf else "_plain"),
        S.with_parts(
            S.kept() | S.vector_ends() | (S.entity_weights(entity) if with_tfidf else {}),
            f"""
SELECT c.{key}, c.review_id, c.word, c.n, {S.r6(weight)} AS weight,
       {S.r6('e.first')} AS first, {S.r6('e.last')} AS last
FROM counts c {join}
JOIN ends e ON c.word = e.word""",
        ),
    )
    def word_level(spark, folder):
        counts, vectors, vocab = _kept(spark, folder)
        vectors = code_words(vectors, vocab)
        rows = E.word_level(counts, vectors, entity, with_tfidf)
        return spell_words(rows, vocab, counts.count()).select(
            key,
            "review_id",
            "word",
            "n",
            rounded("weight").alias("weight"),
            rounded(F.get("vec", F.lit(0))).alias("first"),
            rounded(F.get("vec", F.lit(S.SIZE - 1))).alias("last"),
        )


def _register_entity_vectors(entity, mode):
    key = f"{entity}_id"

    @query(
        f"{entity}_vectors_{mode}",
        S.with_parts(
            S.review_sums(mode) | S.entity_means(entity),
            f"SELECT {key}, dim::int AS dim, {S.r6('value')} AS value FROM {entity}_mean",
        ),
    )
    def entity_vectors(spark, folder):
        sums = _review_sums(spark, folder, mode, [entity])
        return long_vectors(E.entity_means(sums, entity), [key], f"{entity}_vec")


def _register_leave_one_out(mode):
    @query(
        f"leave_one_out_{mode}",
        S.with_parts(
            S.review_sums(mode) | S.leave_one_out(),
            f"""
SELECT user_id, business_id, review_id, dim::int AS dim,
       {S.r6('user_value')} AS user_value, {S.r6('business_value')} AS business_value
FROM loo""",
        ),
    )
    def leave_one_out(spark, folder):
        pairs = E.leave_one_out(_review_sums(spark, folder, mode))
        zipped = F.arrays_zip("user_vec", "business_vec")
        rows = pairs.select(*E.REVIEW_KEYS, F.posexplode(zipped).alias("dim", "x"))
        return rows.select(
            *E.REVIEW_KEYS,
            "dim",
            rounded("x.user_vec").alias("user_value"),
            rounded("x.business_vec").alias("business_value"),
        )


def _register_one_side(entity):
    @query(
        f"leave_one_out_{entity}",
        S.with_parts(
            S.review_sums("tfidf") | S.leave_one_out(),
            f"""
SELECT user_id, business_id, review_id, dim::int AS dim,
       {S.r6(f'{entity}_dv / {entity}_dw')} AS value
FROM rest WHERE {entity}_c > 1""",
        ),
    )
    def leave_one_out_side(spark, folder):
        sums = _review_sums(spark, folder, "tfidf", [entity])
        pairs = E.leave_one_out(sums, [entity])
        return long_vectors(pairs, list(E.REVIEW_KEYS), f"{entity}_vec")


for _entity in E.ENTITIES:
    _register_word_weights(_entity)
    _register_word_level(_entity, True)
    for _mode in MODES:
        _register_entity_vectors(_entity, _mode)
    _register_one_side(_entity)
_register_word_level("user", False)
for _mode in MODES:
    _register_leave_one_out(_mode)


def embedding_pairs(spark, folder):
    """Every embedding as a user's vector beside that of another as a business's."""
    embeddings = tables.table(spark, folder, "embeddings")
    number = embeddings.agg(F.count("*")).scalar()
    vector = V.as_doubles(F.col("embedding"))
    users = embeddings.select(
        F.col("vec_id").alias("user_id"),
        vector.alias("user_vec"),
        ((F.col("vec_id") * 7 + 1) % number).alias("business_id"),
    )
    businesses = embeddings.select(
        F.col("vec_id").alias("business_id"), vector.alias("business_vec")
    )
    return users.join(businesses, "business_id")


_PAIRS = {
    "pairs": """
SELECT u.vec_id AS user_id, b.vec_id AS business_id,
       u.embedding::double[] AS user_vec, b.embedding::double[] AS business_vec
FROM embeddings u JOIN embeddings b
  ON b.vec_id = (u.vec_id * 7 + 1) % (SELECT count(*) FROM embeddings)"""
}


@query(
    "pair_concat",
    S.with_parts(
        _PAIRS,
        f"""
SELECT user_id, business_id, dim::int AS dim, {S.r6('x')} AS value
FROM (SELECT user_id, business_id, unnest(range({2 * S.SIZE})) AS dim,
             unnest(list_concat(user_vec, business_vec)) AS x FROM pairs)""",
    ),
)
def pair_concat(spark, folder):
    joined = V.pair_concat(F.col("user_vec"), F.col("business_vec"))
    rows = embedding_pairs(spark, folder).withColumn("x", joined)
    return long_vectors(rows, ["user_id", "business_id"], "x")


@query(
    "pair_product",
    S.with_parts(
        _PAIRS
        | {
            "long": f"""
SELECT user_id, business_id, unnest(range({S.SIZE})) AS dim,
       unnest(user_vec) AS u, unnest(business_vec) AS b FROM pairs"""
        },
        f"""
SELECT user_id, business_id, dim::int AS dim,
       {S.r6('u / sqrt(sum(u * u) OVER w) * b / sqrt(sum(b * b) OVER w)')} AS value
FROM long WINDOW w AS (PARTITION BY user_id, business_id)""",
    ),
)
def pair_product(spark, folder):
    product = V.pair_product(F.col("user_vec"), F.col("business_vec"))
    rows = embedding_pairs(spark, folder).withColumn("x", product)
    return long_vectors(rows, ["user_id", "business_id"], "x")


@query(
    "analogy_topk",
    S.with_parts(
        {
            "long": f"""
SELECT vec_id, unnest(range({S.SIZE})) AS dim, unnest(embedding)::double AS x FROM embeddings""",
            "units": """
SELECT vec_id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM long""",
            "query": """
SELECT dim, sum(CASE WHEN vec_id = 3 THEN -x ELSE x END) / 3 AS q
FROM units WHERE vec_id IN (3, 4, 5) GROUP BY dim""",
        },
        f"""
SELECT concat('w', vec_id) AS word,
       {S.r6('sum(x * q) / (SELECT sqrt(sum(q * q)) FROM query)')} AS similarity
FROM units JOIN query USING (dim) WHERE vec_id NOT IN (3, 4, 5)
GROUP BY vec_id ORDER BY sum(x * q) DESC, word LIMIT 10""",
    ),
)
def analogy_topk(spark, folder):
    vectors = tables.table(spark, folder, "embeddings").select(
        F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"),
        V.as_doubles(F.col("embedding")).alias("vec"),
    )
    found = similarity.analogy(vectors, "w3", "w4", "w5", S.SIZE)
    return found.withColumn("similarity", rounded("similarity"))


@query(
    "analogy_table",
    S.with_parts(
        {
            "long": f"""
SELECT vec_id, unnest(range({S.SIZE})) AS dim, unnest(embedding)::double AS x FROM embeddings""",
            "units": """
SELECT vec_id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM long""",
            "asked": """
SELECT a.vec_id AS question, a.dim, (b.x + c.x - a.x) / 3 AS q
FROM units a JOIN units b ON b.vec_id = a.vec_id + 1 AND a.dim = b.dim
             JOIN units c ON c.vec_id = a.vec_id + 2 AND a.dim = c.dim
WHERE a.vec_id % 20 = 0""",
            "scored": """
SELECT question, concat('w', vec_id) AS word, sum(x * q) / sqrt(sum(q * q)) AS similarity
FROM units JOIN asked USING (dim)
WHERE vec_id NOT IN (question, question + 1, question + 2) GROUP BY question, vec_id""",
        },
        f"""
SELECT question, word, {S.r6('similarity')} AS similarity,
       row_number() OVER (PARTITION BY question ORDER BY similarity DESC, word)::int AS rank
FROM scored QUALIFY rank <= 10""",
    ),
)
def analogy_table(spark, folder):
    """Every twentieth vector and the two after it make a question to all of them."""
    rows = tables.table(spark, folder, "embeddings")

    def word(number):
        return F.concat(F.lit("w"), number.cast("string"))

    vectors = rows.select(word(F.col("vec_id")).alias("word"), V.as_doubles(F.col("embedding")).alias("vec"))
    first = F.col("vec_id")
    questions = rows.where(first % 20 == 0).select(
        first.alias("question"),
        word(first).alias("base"),
        word(first + 1).alias("version"),
        word(first + 2).alias("target"),
    )
    found = similarity.analogies(vectors, questions, S.SIZE)
    return found.withColumn("similarity", rounded("similarity"))


@query(
    "nearest_centroid",
    S.with_parts(
        {
            "long": f"""
SELECT vec_id, label, unnest(range({S.SIZE})) AS dim, unnest(embedding)::double AS x
FROM embeddings""",
            "centres": "SELECT label, dim, avg(x) AS c FROM long GROUP BY label, dim",
            "gaps": """
SELECT l.vec_id, l.label, c.label AS centre, sum((x - c) * (x - c)) AS distance
FROM long l JOIN centres c ON l.dim = c.dim GROUP BY ALL""",
        },
        """
SELECT vec_id, label, arg_min(centre, (distance, centre)) AS centre
FROM gaps GROUP BY vec_id, label""",
    ),
)
def nearest_centroid(spark, folder):
    points = tables.table(spark, folder, "embeddings").select(
        "vec_id", "label", V.as_doubles(F.col("embedding")).alias("vec")
    )
    middle = stored(similarity.centres(points, "label", "vec", S.SIZE), "centres")
    return similarity.nearest_centre(points, "vec", middle).drop("vec")


@query(
    "unseen_pairs",
    S.with_parts(
        {"reviews": S.REVIEWS_BULK}
        | S.unseen("reviews"),
        "SELECT candidate, user_id, business_id FROM unseen",
    ),
)
def unseen_pairs(spark, folder):
    return sampling.unseen_pairs(tables.reviews_bulk(spark, folder), hashed=sampling.spread_hash)


_TRAINING = (
    S.review_sums("tfidf")
    | S.entity_means("user")
    | S.entity_means("business")
    | S.leave_one_out()
    | {"seen": "SELECT DISTINCT user_id, business_id, review_id FROM loo"}
    | S.unseen("seen")
    | {
        "pairs": """
SELECT concat('s', review_id) AS key, user_id, business_id, 1 AS y, dim,
       user_value AS u, business_value AS b FROM loo
UNION ALL
SELECT concat('u', p.candidate), p.user_id, p.business_id, 0, u.dim, u.value, b.value
FROM unseen p JOIN user_mean u ON p.user_id = u.user_id
JOIN business_mean b ON p.business_id = b.business_id AND u.dim = b.dim""",
        "products": """
SELECT key, user_id, business_id, y, dim,
       u / sqrt(sum(u * u) OVER w) * b / sqrt(sum(b * b) OVER w) AS x
FROM pairs WINDOW w AS (PARTITION BY key)""",
    }
)


@query(
    "training_set",
    S.with_parts(
        _TRAINING,
        f"""
SELECT key, user_id, business_id, y, {S.r6('sum(x)')} AS total,
       {S.r6('sum(x) FILTER (dim = 0)')} AS first
FROM products GROUP BY key, user_id, business_id, y""",
    ),
)
def training_rows(spark, folder):
    reviews, vocab, vectors = _inputs(spark, folder)
    prepared = prepare(reviews, vocab, vectors, Settings(S.SIZE, hashed=sampling.spread_hash))
    rows = training_set(prepared, concatenated=False)
    total = F.aggregate("x", F.lit(0.0), lambda total, x: total + x)
    return rows.select(
        "key",
        "user_id",
        "business_id",
        "y",
        rounded(total).alias("total"),
        rounded(F.get("x", F.lit(0))).alias("first"),
    )


def _split_parts(rows):
    """``split``: key, y, held_out of the subquery ``rows``."""
    return {
        "rows_": rows,
        "sizes": "SELECT y, count(*) AS n FROM rows_ GROUP BY y",
        "exact": """
SELECT y, ceil(sum(n) OVER () * 0.25) AS wanted, ceil(sum(n) OVER () * 0.25) * n / sum(n) OVER () AS part
FROM sizes""",
        "parts": """
SELECT y, floor(part) + (row_number() OVER (ORDER BY floor(part) - part, y)
         <= wanted - sum(floor(part)) OVER ())::int AS take
FROM exact""",
        "split": f"""
SELECT key, r.y, row_number() OVER (PARTITION BY r.y
         ORDER BY {S.spread_hash('key', 'split')}, key) <= p.take AS held_out
FROM rows_ r JOIN parts p ON r.y = p.y""",
    }


@query(
    "lr_holdout",
    S.with_parts(
        _TRAINING
        | _split_parts(
            f"""
SELECT key, y FROM products GROUP BY key, y
HAVING count(x) = {S.SIZE} AND NOT bool_or(isnan(x))"""
        ),
        "SELECT key, y FROM split WHERE held_out",
    ),
)
def lr_holdout(spark, folder):
    """The validation rows of the classifier on vector products."""
    reviews, vocab, vectors = _inputs(spark, folder)
    settings = Settings(S.SIZE, hashed=sampling.spread_hash)
    prepared = prepare(reviews, vocab, vectors, settings)
    held_out = split_training_set(prepared, False, sampling.spread_hash)[1]
    return held_out.select("key", "y")


@query(
    "stratified_split",
    S.with_parts(
        _split_parts("SELECT event_id AS key, event_type AS y FROM events"),
        "SELECT key, y, held_out FROM split",
    ),
)
def stratified_split(spark, folder):
    events = tables.table(spark, folder, "events").select(
        F.col("event_id").alias("key"), F.col("event_type").alias("y")
    )
    return sampling.stratified_split(events, "y", "key", hashed=sampling.spread_hash)


def group_parts(entity):
    key = f"{entity}_id"
    number = key if entity == "user" else "dense_rank() OVER (ORDER BY business_id) - 1"
    return (
        S.kept()
        | {
            "entities": f"""
SELECT {key}, ({number}) % (SELECT count(*) FROM embeddings) AS vec_id
FROM (SELECT DISTINCT {key} FROM reviews)""",
            "groups": f"""
SELECT e.{key}, m.label AS grp FROM entities e JOIN embeddings m ON e.vec_id = m.vec_id""",
            "tf": f"""
SELECT g.grp, c.word, sum(c.n)::bigint AS tf
FROM counts c JOIN groups g ON c.{key} = g.{key} GROUP BY ALL""",
            "present": f"""
SELECT {key}, grp FROM groups WHERE {key} IN (SELECT {key} FROM counts)""",
            "labels_": "SELECT DISTINCT grp FROM present",
        }
        | S.weights("w", "grp", "tf", "labels_")
        | word_label_parts("grp", key, "present", "w")
    )


def given_groups(spark, folder, entity):
    """Users or businesses with the label of a vector as their group (``stored``)."""
    key = f"{entity}_id"
    entities = tables.reviews_text(spark, folder).select(key).distinct()
    embeddings = tables.table(spark, folder, "embeddings")
    number = embeddings.agg(F.count("*")).scalar()
    coded = ids.encode_labels(entities.withColumn("code", F.col(key)), "code")
    place = F.col(key) if entity == "user" else F.col("code")
    labelled = coded.withColumn("vec_id", place % number).join(embeddings, "vec_id")
    return stored(labelled.select(key, F.col("label").alias("group")), "groups")


def _top_words(spark, folder, entity, averaged=False):
    counts, _, vocab = _kept(spark, folder)
    grouped = given_groups(spark, folder, entity)
    codes = vocab.select(F.col("idx").alias("word"))
    top = groups.group_keywords(counts, grouped, codes, entity, averaged=averaged)
    return spell_words(top, vocab)


TOP = """
SELECT arg_position, arg_label, word,
       row_number() OVER (ORDER BY round(stdev, 9) DESC, word)::int AS rank
FROM wl QUALIFY rank <= 500"""


def _averaged_group_parts(entity):
    key = f"{entity}_id"
    given = {name: part for name, part in group_parts(entity).items() if name not in ("pos", "grid", "wl")}
    return (
        given
        | S.entity_weights(entity)
        | {
            "members": "SELECT grp, count(*) AS members FROM present GROUP BY grp",
            "averaged": f"""
SELECT p.grp, e.word, sum(e.weight) / any_value(m.members) AS weight
FROM {entity}_w e JOIN present p ON e.{key} = p.{key} JOIN members m ON p.grp = m.grp
GROUP BY ALL""",
        }
        | word_label_parts("grp", key, "present", "averaged")
    )


def _register_group_keywords(entity):
    @query(f"group_keywords_{entity}", S.with_parts(group_parts(entity), TOP))
    def group_keywords(spark, folder):
        return _top_words(spark, folder, entity)

    @query(
        f"group_keywords_averaged_{entity}",
        S.with_parts(_averaged_group_parts(entity), TOP),
    )
    def group_keywords_averaged(spark, folder):
        return _top_words(spark, folder, entity, averaged=True)

    @query(
        f"group_report_{entity}",
        S.with_parts(
            group_parts(entity) | {"top": TOP},
            """
SELECT arg_position, arg_label, list(word ORDER BY rank) AS words
FROM top GROUP BY arg_position, arg_label""",
        ),
    )
    def group_report(spark, folder):
        return keywords_per_label(_top_words(spark, folder, entity))

    @query(
        f"words_of_groups_{entity}",
        S.with_parts(
            group_parts(entity),
            f"""
SELECT c.{entity}_id, c.word, c.n, g.grp AS "group"
FROM counts c JOIN groups g ON c.{entity}_id = g.{entity}_id""",
        ),
    )
    def words_of_groups(spark, folder):
        counts, _, vocab = _kept(spark, folder)
        words = spell_words(counts.select(f"{entity}_id", "word", "n"), vocab)
        return groups.attach_groups(words, given_groups(spark, folder, entity), entity)


for _entity in E.ENTITIES:
    _register_group_keywords(_entity)
