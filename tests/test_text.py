import pytest
from pyspark.sql import functions as F

from reviewloom.functions import text as T
from reviewloom.functions.fixed_values import STOP_WORDS
from reviewloom.operators.vocabulary import build_vocabulary, index_words, negation_words
from reviewloom.operators.words import all_words


def one(spark, expression, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(expression(F.col("x")).alias("y")).first()["y"]


def test_cleaning_turns_each_mark_into_one_blank(spark):
    reviews = spark.createDataFrame([(1, "It's  Hot-Pot_2!")], "id int, review_text string")
    words = [row["word"] for row in all_words(reviews).collect()]
    assert words == ["it", "s", "", "hot", "pot", "2", ""]


def test_tabs_and_line_ends_stay_inside_tokens(spark):
    assert one(spark, T.split_on_blank, "a\tb c\nd ") == ["a\tb", "c\nd", ""]


def test_words_have_two_characters_in_any_script(spark):
    assert one(spark, T.word_tokens, "Crème a b2 _x Æ über-gut") == [
        "crème", "b2", "_x", "über", "gut",
    ]


@pytest.mark.parametrize(
    "printed, numbers",
    [("[7, 0.5, -12.25]", [7.0, 0.5, -12.25]), ("[]", [None]), ("[1,  2]", [1.0, None, 2.0])],
)
def test_printed_numbers(spark, printed, numbers):
    assert one(spark, T.parse_number_list, printed) == numbers


@pytest.mark.parametrize(
    "printed, words",
    [
        ("['a', 'b', 'c d']", ["a", "b", "c d"]),
        ("[]", [""]),
        ("""["it's", 'b']""", ['"its"', "b"]),
    ],
)
def test_printed_strings(spark, printed, words):
    assert one(spark, T.parse_string_list, printed) == words


def test_strict_printed_strings_keep_apostrophes(spark):
    strict = lambda c: T.parse_string_list(c, strict=True)
    assert one(spark, strict, """["it's", 'b']""") == ["it's", "b"]


def test_word_runs(spark):
    expected = ["slow", "slow roasted", "roasted", "roasted leek", "leek"]
    assert one(spark, T.word_runs, "slow  roasted leek") == expected
    three = one(spark, lambda c: T.word_runs(c, 3), "a b c")
    assert three == ["a", "a b", "a b c", "b", "b c", "c"]
    assert one(spark, lambda c: T.word_runs(c, 1), "a b") == ["a", "b"]
    assert one(spark, T.word_runs, None) == []
    with pytest.raises(ValueError):
        T.word_runs(F.col("x"), 0)


def test_list_columns(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    row = df.select(*T.list_columns(F.col("x"), 2, "x")).first()
    assert row.asDict() == {"x_0": 1.0, "x_1": 2.0}


def test_recipe_words_in_fixed_order(spark):
    df = spark.createDataFrame(
        [("hot pot", "['t']", "['i', 'j']", "['mix']", "very good"), (None, "['t']", "['i']", None, None)],
        "name string, tags string, ingredients string, steps string, description string",
    )
    words = T.recipe_words(["description", "name", "steps", "tags", "ingredients"])
    full, empty = (row[0] for row in df.select(words).collect())
    assert full == [
        "t", "i", "j", "hot", "hot pot", "pot", "mix", "very", "very good", "good",
    ]
    assert empty == ["t", "i"]
    compat = T.recipe_words(["ingredients", "name", "steps"], compat=True)
    assert [row[0] for row in df.select(compat).collect()] == [
        ["i", "j", "hot", "hot pot", "pot", "hot pot"],
        ["i", "nan"],
    ]
    with pytest.raises(ValueError):
        T.recipe_words(["cuisine"])


def test_picture_words(spark):
    df = spark.createDataFrame(
        [("good", [["cup", "pot", "pan"], ["pizza"]]), (None, [["cup"]]), ("plain", None)],
        "text string, tags array<array<string>>",
    )
    words = T.picture_words(F.col("tags"), 2)
    texts = df.select(T.append_picture_words(F.col("text"), words)).collect()
    assert [row[0] for row in texts] == ["good cup pot pizza", " cup", "plain"]


def test_concat_and_join(spark):
    df = spark.createDataFrame([(["a"], None, ["b", "c"])], "x array<string>, y array<string>, z array<string>")
    joined = T.join_words(T.concat_lists(F.col("x"), F.col("y"), F.col("z")))
    assert df.select(joined).first()[0] == "a b c"


def test_negations(spark):
    stop_words = spark.createDataFrame([("the",), ("don't",), ("isn't",)], "word string")
    words = [row["word"] for row in negation_words(stop_words).collect()]
    assert sorted(words) == sorted(
        ["no", "not", "t", "nor", "against", "don't", "isn't", "don", "isn"]
    )
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 179


def test_vocabulary_limits(spark):
    docs = spark.createDataFrame(
        [("the soup soup",), ("Soup salad",), ("salad bread soup",), (None,)], "text string"
    )
    rows = build_vocabulary(docs, "text").orderBy("idx").collect()
    assert [tuple(row[c] for c in ("word", "df", "idx")) for row in rows] == [
        ("bread", 1, 0), ("salad", 2, 1), ("soup", 3, 2),
    ]
    assert [r["word"] for r in build_vocabulary(docs, "text", min_df=2, max_df=0.5).collect()] == ["salad"]
    assert [r["word"] for r in build_vocabulary(docs, "text", min_df=0.6).collect()] == ["soup"]
    given = spark.createDataFrame([("b",), ("a",), ("b",)], "word string")
    assert [tuple(r) for r in index_words(given).orderBy("idx").collect()] == [("a", 0), ("b", 1)]
