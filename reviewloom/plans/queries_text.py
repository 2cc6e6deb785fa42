"""Queries on strings, lists, vocabularies and TF-IDF of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.functions import text as T
from reviewloom.functions.fixed_values import PLAIN_NEGATIONS, STOP_WORDS
from reviewloom.operators import tfidf, vocabulary, words
from reviewloom.operators.durable import lookup, stored
from reviewloom.plans import sql as S
from reviewloom.plans.registry import query, rounded
from reviewloom.sources import reviews as reviews_source
from reviewloom.sources import tables
from reviewloom.sources.recipes import recipe_word_lists
from reviewloom.sources.vectors import lexicon_vectors, to_array, to_columns


def document_vocabulary(spark, folder, min_df=S.MIN_DF):
    """The words of at least ``min_df`` documents."""
    documents = tables.documents(spark, folder)
    return vocabulary.build_vocabulary(documents, "text", min_df=min_df)


@query(
    "tfidf_by_source",
    S.with_parts(
        {
            "occ": f"""
SELECT source, unnest(string_split({S.cleaned('text')}, ' ')) AS word FROM documents""",
            "tf": f"""
SELECT source, word, count(*) AS tf FROM occ
WHERE word <> '' AND word NOT IN ({S.STOP_LIST}) GROUP BY ALL""",
            "docs": "SELECT DISTINCT source FROM tf",
        }
        | S.weights("w", "source", "tf", "docs"),
        f"SELECT source, word, tf, df, {S.r6('weight')} AS weight FROM w",
    ),
)
def tfidf_by_source(spark, folder):
    documents = tables.documents(spark, folder).select("source", "text")
    tokens = words.all_words(documents, "text").where(F.col("word") != "")
    kept = vocabulary.without_words(tokens, STOP_WORDS)
    counts = stored(kept.groupBy("source", "word").agg(F.count("*").alias("tf")), "source-words")
    weighed = tfidf.weigh(counts, "source")
    return weighed.withColumn("weight", rounded("weight"))


@query(
    "clean_words",
    f"""
SELECT doc_id, word, count(*) AS n
FROM (SELECT doc_id, unnest(string_split({S.cleaned('text')}, ' ')) AS word FROM documents)
WHERE word <> '' AND word NOT IN ({S.STOP_LIST}) GROUP BY ALL""",
)
def clean_words(spark, folder):
    documents = tables.documents(spark, folder).select("doc_id", "text")
    tokens = words.all_words(documents, "text").where(F.col("word") != "")
    kept = vocabulary.without_words(tokens, STOP_WORDS)
    return kept.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query(
    "list_numbers",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey::double AS x_0,
       l_linenumber::double + 0.5 AS x_1, l_suppkey::double AS x_2,
       year(l_shipdate)::double AS x_3
FROM lineitem""",
)
def list_numbers(spark, folder):
    lines = tables.table(spark, folder, "lineitem")
    printed = F.concat(
        F.lit("["),
        F.concat_ws(
            ", ",
            F.col("l_partkey").cast("string"),
            F.concat(F.col("l_linenumber").cast("string"), F.lit(".5")),
            F.col("l_suppkey").cast("string"),
            F.date_format("l_shipdate", "yyyy"),
        ),
        F.lit("]"),
    )
    parsed = lines.withColumn("x", T.parse_number_list(printed))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return parsed.select(*keys, *T.list_columns(F.col("x"), 4, "x"))


@query(
    "list_strings",
    S.with_parts(
        {"recipes": S.RECIPES},
        """
SELECT recipe_id, unnest(range(len(items))) AS place, unnest(items) AS item
FROM (SELECT recipe_id,
             string_split(replace(trim(ingredients, '[]'), '''', ''), ', ') AS items
      FROM recipes)""",
    ),
)
def list_strings(spark, folder):
    items = T.parse_string_list(F.col("ingredients"))
    return (
        tables.recipes(spark, folder)
        .select("recipe_id", F.posexplode(items).alias("place", "item"))
        .withColumn("place", F.col("place").cast("bigint"))
    )


_RUNS = """list_filter(flatten(list_transform(range(len(w)), lambda i:
          [w[i + 1], CASE WHEN i + 1 < len(w) THEN w[i + 1] || ' ' || w[i + 2] END])),
          lambda x: x IS NOT NULL)"""


@query(
    "everygrams",
    f"""
SELECT item_id, unnest(range(len(runs))) AS place, unnest(runs) AS run
FROM (SELECT item_id, {_RUNS} AS runs
      FROM (SELECT item_id, string_split(regexp_replace(text, ' +', ' ', 'g'), ' ') AS w
            FROM benchmark))""",
)
def everygrams(spark, folder):
    runs = T.word_runs(F.col("text"), 2)
    return (
        tables.table(spark, folder, "benchmark")
        .select("item_id", F.posexplode(runs).alias("place", "run"))
        .withColumn("place", F.col("place").cast("bigint"))
    )


@query(
    "recipe_words",
    S.with_parts(
        {
            "recipes": S.RECIPES,
            "w": f"""
SELECT recipe_id,
       string_split(replace(trim(tags, '[]'), '''', ''), ', ') AS tags,
       string_split(replace(trim(ingredients, '[]'), '''', ''), ', ') AS ingredients,
       {_RUNS} AS runs
FROM (SELECT *, string_split(regexp_replace(name, ' +', ' ', 'g'), ' ') AS w FROM recipes)""",
        },
        """
SELECT recipe_id, len(tags) + len(ingredients) + len(runs) AS n,
       array_to_string(list_concat(list_concat(tags, ingredients), runs), ' ') AS text
FROM w""",
    ),
)
def recipe_words(spark, folder):
    recipes = tables.recipes(spark, folder)
    listed = recipe_word_lists(recipes, ["name", "ingredients", "tags"])
    return listed.select("recipe_id", F.size("words").cast("bigint").alias("n"), "text")


@query(
    "picture_words",
    """
SELECT p_partkey, concat(CASE WHEN p_size % 3 <> 0 THEN p_name ELSE '' END, ' ',
         array_to_string(string_split(p_name, ' ')[1:10], ' '), ' ',
         array_to_string(string_split(lower(p_brand), '#')[1:10], ' ')) AS review_text,
       concat('https://pictures.example/', p_type) AS link
FROM part""",
)
def picture_words(spark, folder):
    parts = tables.table(spark, folder, "part")
    tagged = parts.select(
        "p_partkey",
        F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("review_text"),
        F.array(F.split("p_name", " "), F.split(F.lower("p_brand"), "#")).alias("tags"),
        T.picture_link(F.col("p_type"), "https://pictures.example/").alias("link"),
    )
    return reviews_source.with_picture_words(tagged, "tags", top=10).drop("tags")


_NEGATIONS = (
    list(PLAIN_NEGATIONS)
    + [word for word in STOP_WORDS if word.endswith("'t")]
    + [word.removesuffix("'t") for word in STOP_WORDS if word.endswith("'t")]
)


@query(
    "negation_words",
    f"""
SELECT word, listed, count(*) AS n
FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM conversations
      UNION ALL SELECT unnest(string_split(lower(text), ' ')) FROM documents) t
JOIN (SELECT w, count(*) AS listed
      FROM (SELECT unnest([{', '.join(S.quoted(w) for w in _NEGATIONS)}]) AS w)
      GROUP BY w) s ON t.word = s.w
GROUP BY word, listed""",
)
def negation_words(spark, folder):
    stop_words = spark.createDataFrame([(word,) for word in STOP_WORDS], "word string")
    negations = (
        vocabulary.negation_words(stop_words)
        .groupBy("word")
        .agg(F.count("*").alias("listed"))
    )
    texts = (
        tables.table(spark, folder, "conversations")
        .select("text")
        .unionByName(tables.documents(spark, folder).select("text"))
    )
    tokens = texts.select(F.explode(T.split_on_blank(F.lower("text"))).alias("word"))
    return (
        tokens.groupBy("word")
        .agg(F.count("*").alias("n"))
        .join(lookup(negations), "word")
        .select("word", "listed", "n")
    )


@query(
    "parallel_lists",
    """
SELECT p_partkey, unnest(string_split(p_name, ' ')) AS part_word,
       unnest(list_transform(string_split(p_name, ' '), lambda w: length(w))) AS size
FROM part""",
)
def parallel_lists(spark, folder):
    parts = tables.table(spark, folder, "part").select(
        "p_partkey", F.split("p_name", " ").alias("part_word")
    )
    sizes = F.transform("part_word", lambda word: F.length(word).cast("bigint")).alias("size")
    return parts.select("p_partkey", F.inline(F.arrays_zip("part_word", sizes)))


@query("vocabulary", S.with_parts(S.vocabulary(2), "SELECT word, idx, df FROM vocab"))
def vocabulary_words(spark, folder):
    documents = tables.documents(spark, folder)
    return vocabulary.build_vocabulary(documents, "text", min_df=2).select("word", "idx", "df")


@query(
    "vocabulary_by_share",
    f"""
SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx, df
FROM (SELECT word, count(DISTINCT doc_id) AS df
      FROM (SELECT doc_id, unnest({S.tokens('text')}) AS word FROM documents) GROUP BY word)
WHERE df >= 0.002 * (SELECT count(*) FROM documents)::double
  AND df <= 0.5 * (SELECT count(*) FROM documents)::double""",
)
def vocabulary_by_share(spark, folder):
    documents = tables.documents(spark, folder)
    built = vocabulary.build_vocabulary(
        documents, "text", stop_words=(), min_df=0.002, max_df=0.5
    )
    return built.select("word", "idx", "df")


@query(
    "lexicon",
    f"""
SELECT DISTINCT word FROM (SELECT unnest({S.tokens('text')}) AS word FROM documents)
WHERE word NOT IN ({S.STOP_LIST})""",
)
def lexicon(spark, folder):
    documents = tables.documents(spark, folder)
    counted = vocabulary.word_document_counts(documents, "text")
    return vocabulary.lexicon(counted)


@query(
    "vector_layouts",
    S.with_parts(
        S.vocabulary(),
        "SELECT v.word, "
        + ", ".join(f"{S.r6(f'e.embedding[{i + 1}]::double')} AS v{i}" for i in range(S.SIZE))
        + " FROM vocab v JOIN embeddings e"
        " ON e.vec_id = v.idx % (SELECT count(*) FROM embeddings)",
    ),
)
def vector_layouts(spark, folder):
    vocab = document_vocabulary(spark, folder)
    vectors = tables.word_vectors(spark, folder, vocab)
    chosen = lexicon_vectors(vectors, vocabulary.lexicon(vocab))
    back = to_array(to_columns(chosen, S.SIZE), S.SIZE)
    wide = to_columns(back, S.SIZE)
    return wide.select("word", *[rounded(f"v{i}").alias(f"v{i}") for i in range(S.SIZE)])


@query(
    "document_tfidf",
    S.with_parts(
        S.vocabulary()
        | {
            "tf": f"""
SELECT doc_id, word, count(*) AS tf
FROM (SELECT doc_id, unnest({S.tokens('text')}) AS word FROM documents)
WHERE word IN (SELECT word FROM vocab) GROUP BY ALL"""
        }
        | S.weights("w", "doc_id", "tf", "documents"),
        f"SELECT doc_id, word, tf, df, {S.r6('weight')} AS weight FROM w",
    ),
)
def document_tfidf(spark, folder):
    vocab = document_vocabulary(spark, folder)
    documents = tables.documents(spark, folder)
    weighed = tfidf.document_weights(documents, "doc_id", "text", vocab)
    return weighed.withColumn("weight", rounded("weight"))


_LANG_TF = f"""
SELECT lang, word, count(*) AS tf
FROM (SELECT lang, unnest({S.tokens(S.cleaned('text'))}) AS word FROM documents)
WHERE word IN (SELECT word FROM vocab) GROUP BY ALL"""

_LANG_JOINED = (
    S.vocabulary()
    | {"tf": _LANG_TF, "labels_": "SELECT DISTINCT lang FROM documents"}
    | S.weights("w", "lang", "tf", "labels_")
)


@query(
    "group_tfidf_join",
    S.with_parts(
        _LANG_JOINED, f"SELECT lang, word, tf, df, {S.r6('weight')} AS weight FROM w"
    ),
)
def group_tfidf_join(spark, folder):
    vocab = document_vocabulary(spark, folder)
    documents = tables.documents(spark, folder)
    weighed = tfidf.label_weights_joined(documents, "lang", "text", vocab)
    return weighed.withColumn("weight", rounded("weight"))


_SOURCE_AVERAGED = (
    S.vocabulary()
    | {
        "tf": f"""
SELECT doc_id, word, count(*) AS tf
FROM (SELECT doc_id, unnest({S.tokens(S.cleaned('text'))}) AS word FROM documents)
WHERE word IN (SELECT word FROM vocab) GROUP BY ALL"""
    }
    | S.weights("w", "doc_id", "tf", "documents")
    | {
        "averaged": """
SELECT d.source, w.word, sum(w.weight) / s.n AS weight
FROM w JOIN documents d ON w.doc_id = d.doc_id
JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) s ON d.source = s.source
GROUP BY d.source, w.word, s.n"""
    }
)


@query(
    "group_tfidf_mean",
    S.with_parts(
        _SOURCE_AVERAGED, f"SELECT source, word, {S.r6('weight')} AS weight FROM averaged"
    ),
)
def group_tfidf_mean(spark, folder):
    vocab = document_vocabulary(spark, folder)
    documents = tables.documents(spark, folder)
    averaged = tfidf.label_weights_averaged(documents, "doc_id", "source", "text", vocab)
    return averaged.withColumn("weight", rounded("weight"))


def word_label_parts(label: str, order: str, rows: str, weights: str) -> dict[str, str]:
    """``wl``: per word of ``vocab`` the strongest label and the spread over all labels."""
    return {
        "pos": f"""
SELECT label, row_number() OVER (ORDER BY first, label) - 1 AS position
FROM (SELECT {label} AS label, min({order}) AS first FROM {rows} GROUP BY {label})""",
        "grid": f"""
SELECT v.word, p.label, p.position, coalesce(w.weight, 0.0) AS weight
FROM vocab v CROSS JOIN pos p
LEFT JOIN {weights} w ON w.word = v.word AND w.{label} = p.label""",
        "wl": """
SELECT word, arg_max(position, (round(weight, 9), -position)) AS arg_position,
       arg_max(label, (round(weight, 9), -position)) AS arg_label,
       stddev_pop(weight) AS stdev
FROM grid GROUP BY word""",
    }


@query(
    "word_label",
    S.with_parts(
        _LANG_JOINED | word_label_parts("lang", "doc_id", "documents", "w"),
        f"SELECT word, arg_position, arg_label, {S.r6('stdev')} AS stdev FROM wl",
    ),
)
def word_label(spark, folder):
    vocab = document_vocabulary(spark, folder)
    documents = tables.documents(spark, folder)
    weights = stored(
        tfidf.label_weights_joined(documents, "lang", "text", vocab), "label-weights"
    )
    positions = stored(tfidf.label_positions(documents, "lang", "doc_id"), "positions")
    labels = tfidf.word_labels(weights, "lang", positions, vocab)
    return labels.withColumn("stdev", rounded("stdev"))


@query(
    "word_label_table",
    S.with_parts(
        _LANG_JOINED | word_label_parts("lang", "doc_id", "documents", "w"),
        f"""
SELECT wl.word, arg_position, arg_label, {S.r6('stdev')} AS stdev, w.lang,
       {S.r6('w.weight')} AS weight
FROM wl LEFT JOIN w ON wl.word = w.word""",
    ),
)
def word_label_table(spark, folder):
    """Words with their label and spread, and a row for each label they have a weight in."""
    vocab = document_vocabulary(spark, folder)
    documents = tables.documents(spark, folder)
    weights = stored(
        tfidf.label_weights_joined(documents, "lang", "text", vocab), "label-weights"
    )
    positions = stored(tfidf.label_positions(documents, "lang", "doc_id"), "positions")
    labels = tfidf.word_labels(weights, "lang", positions, vocab)
    cells = labels.join(weights.select("word", "lang", "weight"), "word", "left")
    return cells.select(
        "word",
        "arg_position",
        "arg_label",
        "lang",
        *[rounded(name).alias(name) for name in ("stdev", "weight")],
    )


@query(
    "word_label_mean",
    S.with_parts(
        _SOURCE_AVERAGED | word_label_parts("source", "doc_id", "documents", "averaged"),
        f"SELECT word, arg_position, arg_label, {S.r6('stdev')} AS stdev FROM wl",
    ),
)
def word_label_mean(spark, folder):
    vocab = document_vocabulary(spark, folder)
    documents = tables.documents(spark, folder)
    weights = stored(
        tfidf.label_weights_averaged(documents, "doc_id", "source", "text", vocab),
        "label-weights",
    )
    positions = stored(tfidf.label_positions(documents, "source", "doc_id"), "positions")
    labels = tfidf.word_labels(weights, "source", positions, vocab)
    return labels.withColumn("stdev", rounded("stdev"))
