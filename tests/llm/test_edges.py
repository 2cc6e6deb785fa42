"""Nulls, empty and very long texts, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from reviewloom.llm import (
    chat,
    embeddings,
    line_dedup,
    mixing,
    packing,
    pii,
    quality,
    secrets,
    simhash,
    toxicity,
)
from reviewloom.llm.queries import tokenizer_files

LINE = "a line that is long enough to be compared with others"
# Names that operators use inside or return.
EXTRA = "id row n fp at text_hash lines size copies score n_lines h1 place root rate _id _own"

ROWS = [
    (1, None, "a"),
    (2, "", None),
    (3, "one two three four five", "b"),
    (3, "one two three four five", "b"),
    (None, LINE, "a"),
    (None, None, None),
    (4, "word " * 200_000, "a"),
    (5, " \t\n\x0b\x0c\r ", "c"),
    (6, LINE + "\n" + LINE, "c"),
    *[(n, f"{LINE}\nand {n} more", "b") for n in range(10, 16)],
]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame(ROWS, "doc_id bigint, text string, source string")
    return base.select("*", *[F.lit("x").alias(name) for name in EXTRA.split()])


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(3, 1, 0), (10, 1, 1), (10, 1, 0), (11, None, None), (None, 1, 1), (4, 0, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def packed(docs):
    return packing.packed(docs, **tokenizer_files())


def per_row(name, docs, labels):
    return {
        "quality": lambda: quality.judged(docs, labels),
        "simhash": lambda: simhash.near_copies(docs),
        "mixing": lambda: mixing.mix_plan(docs),
        "lines": lambda: line_dedup.drop_shared_lines(docs),
        "pii": lambda: pii.personal_data(docs),
        "toxicity": lambda: toxicity.scores(docs, labels),
        "secrets": lambda: secrets.secrets(docs, settings=secrets.Settings(max_findings=200, passes=1)),
    }[name]()


NAMES = ["quality", "simhash", "mixing", "lines", "pii", "toxicity", "secrets"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_every_row(docs, labels, name):
    found = per_row(name, docs, labels).select("doc_id").collect()
    key = lambda x: (x is None, x)
    assert sorted((r.doc_id for r in found), key=key) == sorted((r[0] for r in ROWS), key=key)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs, labels, name):
    assert per_row(name, docs.limit(0), labels.limit(0)).count() == 0


def test_empty_tables_of_the_others(spark, docs):
    assert packed(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert simhash.one_of_each(docs.limit(0)).count() == 0
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert embeddings.near_vectors(vectors).count() == 0
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.formatted_chats(turns, "conv_id").count() == 0


def test_stages_keep_the_columns(docs, labels):
    for found in (toxicity.without_toxic(docs, labels), simhash.one_of_each(docs), mixing.mixed(docs)):
        assert found.columns == docs.columns
        assert found.count()


def test_defined_values_on_the_edges(docs, labels):
    judged = {(r.doc_id, r.n_words): r for r in quality.judged(docs, labels).collect()}
    assert judged[1, 0].base_failed and not judged[1, 0].kept
    assert judged[4, 200_000].n_repeat_words == 200_000
    near = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_copies(docs).collect()]
    assert {c for d, f, c in near if d in (1, 2, 5)} == {1}
    assert {f for d, f, _ in near if d in (1, 2, 5)} == {0}
    pieces = packed(docs).collect()
    # Every row of a repeated key is packed for itself; empty texts are the closing id alone.
    assert sum(r.length for r in pieces if r.doc_id == 1) == 1
    twice = [r for r in pieces if r.doc_id == 3]
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens
    lines = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_shared_lines(docs).collect()]
    # The largest key that holds the line keeps it; rows without a key never do.
    assert (15, 2, 0, f"{LINE}\nand 15 more") in lines
    assert (6, 2, 2, "") in lines and (None, 1, 1, "") in lines and (None, 1, 0, "") in lines
