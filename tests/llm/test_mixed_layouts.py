"""Rows that fit a layout only with nulls or beside columns that another layout knows."""

import pytest

from reviewloom.llm import chat


def turns(spark, rows, kind):
    found = chat.with_turns(spark.createDataFrame(rows, kind)).select("k", "turns").collect()
    return {r.k: [(t.role, t.text or "") for t in r.turns] for r in found if r.turns is not None}


def test_known_extra_columns_and_nulls(spark):
    kind = "k bigint, instruction string, input string, output string, text string"
    rows = [(1, "i", "x", "o", "t"), (2, "i", None, "o", None), (3, "i", "x", None, "t"), (4, None, "x", "o", "t")]
    assert turns(spark, rows, kind) == {
        1: [("user", "i\n\nx"), ("assistant", "o")],
        2: [("user", "i"), ("assistant", "o")],
        3: [("user", "i\n\nx"), ("assistant", "")],
        4: [("user", "x"), ("assistant", "o")],
    }
    kind = "k bigint, turn bigint, role string, text string, input string, answer string"
    rows = [(1, 0, "user", "q", "x", "y"), (2, 0, "user", "q", None, None)]
    assert turns(spark, rows, kind) == {1: [("user", "q")], 2: [("user", "q")]}
    kind = "k bigint, prompt string, response string, messages array<struct<role:string,content:string>>"
    rows = [(1, "q", None, None), (2, "q", "a", None), (3, None, None, [("user", "m")]), (4, None, "a", None), (5,) + (None,) * 3]
    assert turns(spark, rows, kind) == {
        1: [("user", "q"), ("assistant", "")],
        2: [("user", "q"), ("assistant", "a")],
        3: [("user", "m")],
        4: [("user", ""), ("assistant", "a")],
    }


def test_a_row_without_a_layout_is_an_error(spark):
    kind = "k bigint, text string, messages array<struct<role:string,content:string>>"
    with pytest.raises(Exception, match="no layout for a row with text"):
        turns(spark, [(1, "t", None)], kind)


def test_the_plan_hashes_the_paths_of_each_row(spark):
    kind = "k bigint, turn bigint, role string, text string"
    table = spark.createDataFrame([(1, 0, "user", "q"), (1, None, None, None)], kind)
    assert "xxhash64" in chat.with_turns(table)._jdf.queryExecution().optimizedPlan().toString()
    known = chat.mappings(table)
    assert sorted(paths for paths, _ in known.values()) == [[], ["role", "text", "turn"]]


def test_other_columns_stay(spark):
    kind = "k bigint, prompt string, response string, _shape string, place int, id string, number int, turns int"
    table = spark.createDataFrame([(1, "q", "a", "s", 1, "i", 2, 3)], kind)
    row = chat.with_turns(table).first()
    assert (row["_shape"], row.place, row.id, row.number) == ("s", 1, "i", 2)
    assert [tuple(t)[1:] for t in row.turns] == [("user", "q"), ("assistant", "a")]
    chats = chat.formatted_chats(table, "k").collect()
    assert [r.formatted for r in chats] == ["<turn>user</role>q</turn>\n<turn>assistant</role>a</turn>\n"]
