"""Languages: the kernel against sets, the regression against numpy, held-out labels, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import language
from reviewloom.llm.queries import QUERIES


def plain_grams(text):
    """Sets of n-grams by order: runs of letters with their borders."""
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    low = " ".join(low.split())
    edges = ("".join(c if c.isalpha() else " " for c in text.lower()))
    pad = lambda on: "  " if on else " "
    low = pad(edges[:1] == " ") + low + pad(edges[-1:] == " ")
    return [{low[i : i + n] for i in range(len(low) - n + 1)} for n in range(1, language.ORDERS + 1)]


@pytest.mark.parametrize("text", ["Hello, wide WORLD", "añb  ß1ß", " x", "a", "ein Satz! und noch einer.", "привет мир"])
def test_presence_counts_distinct_runs(text):
    places, sizes = language.presence(text, 20)
    assert sizes.tolist() == [len(grams) for grams in plain_grams(text)]
    assert len(places) == sizes.sum() and (np.diff(places) > 0).all()


def test_kernel_is_the_blended_share_of_common_runs():
    texts = ["one two three", "two three four", "drei vier"]
    rows = [language.presence(x, 20) for x in texts]
    columns = np.zeros((language.ORDERS << 20, 3), np.float32)
    for n, (places, sizes) in enumerate(rows):
        columns[places, n] = language._row(places, sizes)
    found = language.kernel(rows, columns)
    grams = [plain_grams(x) for x in texts]
    expected = [
        [np.mean([len(a & b) / np.sqrt(len(a) * len(b)) for a, b in zip(x, y, strict=True)]) for y in grams]
        for x in grams
    ]
    assert np.allclose(found, expected, atol=1e-6) and np.allclose(np.diag(found), 1, atol=1e-6)


def test_regression_equals_numpy(spark):
    """With every text a landmark, Nyström leaves plain kernel ridge regression on its range."""
    texts = [f"{a} {b}" for a in ("the cat", "the dog", "a house") for b in ("runs", "sleeps")]
    texts += [f"{a} {b}" for a in ("die katze", "der hund", "ein haus") for b in ("rennt", "schläft")]
    rows = [(n, t, "en" if n < 6 else "de") for n, t in enumerate(texts)]
    settings = language.Settings(bits=16, landmarks=100, max_labelled=1000, ridge=0.01)
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "doc_id", "text", "lang", settings)
    held = [language.presence(x, 16) for x in texts]
    columns = np.zeros((language.ORDERS << 16, len(texts)), np.float32)
    for n, (places, sizes) in enumerate(held):
        columns[places, n] = language._row(places, sizes)
    gram = language.kernel(held, columns).astype(float)
    aims = np.array([[1.0, -1.0] if r[2] == "de" else [-1.0, 1.0] for r in rows])
    duals = np.linalg.solve(gram + 0.01 * len(rows) * np.eye(len(rows)), aims)
    assert model.languages == ["de", "en"]
    assert np.allclose(language.kernel(held, model.weights), gram @ duals, atol=1e-3)


def test_held_out_languages(spark, folder):
    big = folder.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op13_language"](spark, big).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 3000
    assert sum(r.lang_pred == r.lang for r in rows) > 0.995 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = language.held_out(F.col("doc_id"))
    spoiled = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    plain, other = (
        sorted(map(tuple, language.languages(d, d.where(~held)).collect())) for d in (docs, spoiled)
    )
    assert plain == other


def test_odd_tables(spark):
    schema = "doc_id bigint, text string, lang string, row string, turn int, id int"
    known = [(1, "the cat sat", "en", "x", 1, 1), (2, "le chat est", "fr", None, 2, 2), (2, None, "fr", "", 3, 3), (3, "...", "de", "", 1, 1)]
    rows = [(None, "the cat", None, "x", 1, 1), (4, None, None, None, None, None), (4, "", "en", "", 1, 1), (4, "12 !?", "en", "", 1, 1), (5, "le chat " * 20_000, None, "", 1, 1)]
    table, labels = spark.createDataFrame(rows, schema), spark.createDataFrame(known, schema)
    found = sorted((str(r.doc_id), r.lang_pred, r.score > 0) for r in language.languages(table, labels).collect())
    assert found == [("4", "und", False)] * 3 + [("5", "fr", True), ("None", "en", True)]
    assert {r.lang_pred for r in language.languages(table, labels.limit(0)).collect()} == {"und"}
    assert language.languages(table.limit(0), labels).collect() == []
