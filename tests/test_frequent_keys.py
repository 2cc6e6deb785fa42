"""Large dictionaries: only rows of rare keys travel, and nothing is lost or doubled."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.functions.text import counted
from reviewloom.operators import durable
from reviewloom.operators import entity_vectors as E
from reviewloom.operators import words as W

IDS = "user_id int, business_id string, review_id int"


def listed(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("limit", [100_000, 700, 0])
def test_entries_of_frequent_and_rare_keys(spark, limit):
    keys = ["hot"] * 500 + ["unknown"] * 300 + ["warm"] * 40 + [f"k{i}" for i in range(30)] + [None] * 7
    rows = spark.createDataFrame(list(enumerate(keys)), "n int, word string")
    entries = [("hot", 1), ("warm", 2), ("warm", 3), (None, 4)] + [(f"k{i}", i) for i in range(0, 60, 2)]
    table = spark.createDataFrame(entries, "word string, code int")
    found = durable.with_entries(rows, table, "word", limit)
    assert found.columns == ["word", "n", "code"]
    assert listed(found) == listed(rows.join(table, "word"))
    if limit == 700:
        frequent = durable._frequent_keys(rows, table, "word", limit // 2)
        assert {row["word"] for row in frequent.collect()} == {"hot", "unknown", "warm"}


def test_words_are_counted_within_the_row(spark, capsys):
    texts = ["b a b", "", None, "a  a\tc ", "the the the"]
    rows = spark.createDataFrame(list(enumerate(texts)), "review_id int, review_text string")
    found = W.counted_words(rows)
    expected = [(i, w, n) for i, t in enumerate(texts) if t is not None for w, n in Counter(t.split(" ")).items()]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    found.explain()
    assert "Aggregate" not in capsys.readouterr().out
    assert spark.range(1).select(counted(F.lit(None).cast("array<string>")).alias("x")).first()["x"] is None


def test_usable_words_by_occurrence_and_by_word(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a", 1, "soup soup x"), (2, "b", 2, "x soup")], f"{IDS}, review_text string")
    usable = spark.createDataFrame([("soup",), ("soup",), ("bread",)], "word string")
    for limit in (1 << 20, 0):
        monkeypatch.setattr(durable, "BROADCAST_BYTES", limit)
        assert Counter(r["review_id"] for r in W.review_words(rows, usable).collect()) == {1: 2, 2: 1}
        by_word = W.review_word_counts(W.review_words(rows, usable, by_word=True))
        assert {(r["review_id"], r["n"]) for r in by_word.collect()} == {(1, 2), (2, 1)}


def test_words_of_repeated_reviews_are_added_up(spark):
    rows = [(1, "a", 1), (1, "a", 1), (None, "a", None), (None, "a", None), (2, "b", 2)]
    reviews = spark.createDataFrame(rows, IDS)
    words = spark.createDataFrame([(*row, "soup", i + 1) for i, row in enumerate(rows)], f"{IDS}, word string, n bigint")
    found = {tuple(r) for r in W.one_row_per_word(reviews, words).collect()}
    assert found == {(1, "a", 1, "soup", 3), (None, "a", None, "soup", 7), (2, "b", 2, "soup", 5)}


@pytest.mark.parametrize(
    "weighting", [E.Weighting(), E.Weighting(weighted_vectors=True), E.Weighting(with_tfidf=False)]
)
def test_review_sums_with_vectors_beyond_a_broadcast(spark, monkeypatch, weighting):
    counts = [(i % 3, "ab"[i % 2], i, f"w{j}", 1 + j % 2) for i in range(12) for j in range(0, 9, 1 + i % 4)]
    counts += [(None, "a", 90, "w1", 2), (1, None, None, "w2", 1), (1, "a", 91, "no vector", 1)]
    counts = spark.createDataFrame(counts, f"{IDS}, word string, n bigint")
    vectors = [(f"w{j}", [float(j), 1.0, -0.5 * j]) for j in [*range(9), 4]]
    vectors = spark.createDataFrame(vectors, "word string, vec array<double>")

    def sums():
        rows = E.review_sums(counts, vectors, 3, weighting).rows
        names = sorted(rows.columns)
        flat = [[x for c in names for x in (row[c] if isinstance(row[c], list) else [row[c]])] for row in rows.collect()]
        return sorted([[round(x, 9) if isinstance(x, float) else x for x in row] for row in flat], key=repr)

    whole = sums()
    assert len(whole) == 14
    monkeypatch.setattr(E, "VECTOR_BROADCAST_BYTES", 600)
    monkeypatch.setattr(durable, "BROADCAST_BYTES", 100)
    assert sums() == whole


def test_weights_found_in_turns(spark, monkeypatch):
    counts = [(i % 3, "ab"[i % 2], i, f"w{j}", 1 + j % 2) for i in range(12) for j in range(0, 9, 1 + i % 4)]
    counts = spark.createDataFrame(counts + [(None, "a", 90, "w1", 2)], f"{IDS}, word string, n bigint")
    vectors = [(f"w{j}", [float(j), 1.0]) for j in range(7)]
    vectors = spark.createDataFrame(vectors, "word string, vec array<double>")

    def weights():
        rows = E.review_sums(counts, vectors, 2).of(["user"]).collect()
        return sorted([(r["review_id"], r["user_weight"] and round(r["user_weight"], 9)) for r in rows])

    whole = weights()
    assert len(whole) == 13
    monkeypatch.setattr(E, "TURN_BYTES", 1000)
    assert weights() == whole


@pytest.mark.parametrize("weighting", [E.Weighting(), E.Weighting(weighted_vectors=True)])
def test_vectors_of_spelled_words_are_never_written(spark, monkeypatch, weighting):
    counts = [(i % 3, "ab"[i % 2], i, j, 1 + j % 2) for i in range(12) for j in range(0, 9, 1 + i % 4)]
    counts = spark.createDataFrame(counts, f"{IDS}, word bigint, n bigint")
    vocabulary = spark.createDataFrame([(f"w{j}", j) for j in range(9)], "word string, idx int")
    # Twice the same word, one without an index, and one with an index and no vector.
    vectors = [(f"w{j}", [float(j), 1.0, -0.5 * j]) for j in [*range(8), 4]] + [("unknown", [9.0, 9.0, 9.0])]
    vectors = spark.createDataFrame(vectors, "word string, vec array<double>")
    coded = vectors.join(vocabulary, "word").select(F.col("idx").alias("word"), "vec")

    def rounded(df):
        flat = [[x for value in row for x in (value if isinstance(value, list) else [value])] for row in df.collect()]
        return sorted([[round(x, 9) if isinstance(x, float) else x for x in row] for row in flat], key=repr)

    whole = rounded(E.leave_one_out(E.review_sums(counts, coded, 3, weighting)))
    assert len(whole) == 12
    monkeypatch.setattr(E, "VECTOR_BROADCAST_BYTES", 600)
    monkeypatch.setattr(E, "TURN_BYTES", 1000)
    # No table of words holds vectors, and the sums of a turn take the place of those before.
    written, most = [], []

    def stored(df, label, *more):
        found = durable.stored(df, label, *more)
        written.append((label, found.columns))
        most.append(len([path for path in folders() if "vector-part" in path]))
        return found

    def folders():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(durable._own_folder(spark))
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        return [str(file.getPath()) for file in files]

    monkeypatch.setattr(E, "stored", stored)
    before = len([path for path in folders() if "vector-part" in path])
    assert rounded(E.leave_one_out(E.review_sums(counts, vectors, 3, weighting, vocabulary))) == whole
    assert len([label for label, _ in written if label == "vector-part"]) >= 3
    assert not [label for label, columns in written if "vec" in columns and "word" in columns]
    assert max(most) <= before + 4


def test_turns_do_not_grow_with_the_vocabulary(spark, monkeypatch):
    words = [(i % 3, "ab"[i % 2], i, j if j < 5 else 5 + 40 * i + j, 1 + j % 2) for i in range(12) for j in range(40)]
    counts = spark.createDataFrame(words, f"{IDS}, word bigint, n bigint")
    vectors = spark.createDataFrame([(j, [float(j), 1.0]) for j in range(600)], "word bigint, vec array<double>")

    def found():
        rows = E.leave_one_out(E.review_sums(counts, vectors, 2)).collect()
        return {r["review_id"]: [round(x, 9) for x in (*r["user_vec"], *r["business_vec"])] for r in rows}

    whole = found()
    assert len(whole) == 12
    monkeypatch.setattr(E, "VECTOR_BROADCAST_BYTES", 600)
    monkeypatch.setattr(E, "TURN_BYTES", 1000)
    written, shuffled = [], []
    monkeypatch.setattr(E, "stored", lambda df, label, *more: written.append(label) or durable.stored(df, label, *more))
    monkeypatch.setattr(E, "dealt", lambda rows, *keys, number: shuffled.append(keys) or durable.dealt(rows, *keys, number=number))
    assert found() == whole
    # Not one for every few vectors, and the words of both sides are shuffled together.
    assert written.count("vector-part") <= 1 + E.MOST_WIDE_TURNS
    assert shuffled.count(("word",)) <= 2 * E.MOST_WIDE_TURNS + E.MOST_WEIGHT_TURNS
    assert not [keys for keys in shuffled if set(keys) & {"user_id", "business_id"} and "review_id" not in keys]


def test_weights_of_words_without_and_with_several_vectors(spark):
    counts = [(1, "a", 1, 0, 2), (1, "a", 1, 1, 1), (1, "b", 2, 0, 3), (None, "b", 3, 0, 1), (2, None, None, 1, 4), (2, "b", 4, 2, 1)]
    frame = spark.createDataFrame(counts, "user_id int, business_id string, review_id int, word int, n int")
    vectors = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (1, [5.0])], "word int, vec array<double>")
    sums = E.review_sums(frame, vectors, 1)
    rows = {r["review_id"]: r for r in sums.rows.collect()}
    idf = {0: np.log(3 / 2) + 1, 1: np.log(3 / 3) + 1, 2: np.log(3 / 2) + 1}  # users 1 and 2
    assert set(rows) == {1, 2, 3, None}
    assert rows[1]["user_weight"] == pytest.approx(2 * 2 * 5 * idf[0] + 1 * 1 * idf[1])
    assert rows[2]["user_weight"] == pytest.approx(3 * 2 * 5 * idf[0]) and rows[3]["user_weight"] is None
    assert rows[None]["user_weight"] == pytest.approx(4 * 4 * idf[1]) and rows[None]["business_weight"] is None
    assert rows[1]["vec"] == pytest.approx([2 * 3.0 + 5.0])
    lengths = {r["user_id"]: r["length"] for r in sums.lengths("user").collect()}
    assert lengths == pytest.approx({1: np.hypot(5 * idf[0], idf[1]), 2: np.hypot(4 * idf[1], idf[2])})
    totals = {r["user_id"]: r["weight"] for r in sums.totals("user").collect()}
    assert totals[1] == pytest.approx(5 * 2 * 5 * idf[0] + idf[1])


def test_words_of_an_entity_in_turns(spark, monkeypatch):
    words = [(i % 3 or None, "ab"[i % 2], i, j % 7, 1 + j % 2) for i in range(30) for j in range(40)]
    counts = spark.createDataFrame(words, f"{IDS}, word int, n bigint")
    whole = listed(E._entity_words(counts, "user"))
    monkeypatch.setattr(E, "TURN_BYTES", 20_000)
    shuffled = []
    monkeypatch.setattr(E, "dealt", lambda rows, *keys, number: shuffled.append(rows.count()) or durable.dealt(rows, *keys, number=number))
    assert listed(E._entity_words(counts, "user")) == whole
    assert len(shuffled) > 3 and sum(shuffled) == 800 and max(shuffled) < 500


def test_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(durable, "TASK_BYTES", 100 * durable.ROW_BYTES)
    rows = spark.range(3000).withColumn("b", F.col("id") % 7)
    for found in (durable.dealt(rows, "id"), durable.dealt(rows, "id", number=3000).groupBy("id").count()):
        assert found.rdd.getNumPartitions() == 30
        assert found.count() == 3000
    words = [(i % 3, "ab"[i % 2], i, j, 1) for i in range(30) for j in range(40)]
    counts = spark.createDataFrame(words, f"{IDS}, word int, n bigint")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        table = E._entity_words(counts, "user")
        assert len([f for f in table.inputFiles()]) >= 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_written_tables_go_when_released(spark):
    first = durable.stored(spark.range(10), "first")
    second = durable.stored(first.repartition(2, "id"), "second")
    files = first.inputFiles()
    durable.released(first)
    assert second.count() == 10
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0])
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
