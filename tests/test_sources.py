import csv
import io

import pytest

from reviewloom.operators import learning
from reviewloom.operators.vocabulary import build_vocabulary
from reviewloom.sources import recipes, reviews, vectors

RECORDS = [
    {"business_id": "b1", "user_id": "u1", "rating": 5, "review_text": "It's good", "pics": ["p1"]},
    {"business_id": "b2", "user_id": None, "review_text": None},
]


def test_review_literals_become_json_lines(spark, tmp_path):
    printed = {"train": RECORDS[:1], "val": RECORDS[1:], "test": []}
    (tmp_path / "in.json").write_text(repr(printed) + "\n")
    reviews.literal_to_json_lines(spark, str(tmp_path / "in.json"), str(tmp_path / "out"))
    rows = sorted(reviews.read_review_lines(spark, str(tmp_path / "out")).collect())
    assert [tuple(row) for row in rows] == [
        ("b1", "u1", 5, "It's good", ["p1"]),
        ("b2", None, None, None, None),
    ]


def test_printed_files_are_read_by_many_tasks(spark, tmp_path):
    texts = ["It's", 'a "good" one', "both ' and \"", "} ], {", "[x]}", "", "two\nlines", "caf\u00e9 }, {'x': "]
    records = [
        {
            "business_id": f"b{i}",
            "user_id": None if i % 7 == 0 else f"u{i}",
            "rating": i % 5 + 1,
            "review_text": texts[i % len(texts)],
            "pics": None if i % 3 else [f"p{i}", "q"],
        }
        for i in range(400)
    ]
    # Records that start with another key, alone and in a row.
    records[11] = {"user_id": "other", "business_id": "b11"}
    records[12] = {"rating": 3}
    printed = {"train": records[:300], "val": [], "test": records[300:]}
    (tmp_path / "in.txt").write_text(repr(printed))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        out = str(tmp_path / "out")
        reviews.literal_to_json_lines(spark, str(tmp_path / "in.txt"), out)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len([p for p in (tmp_path / "out").glob("part-*") if p.stat().st_size]) >= 4
    found = reviews.read_review_lines(spark, out).collect()
    keys = ("business_id", "user_id", "rating", "review_text", "pics")
    wanted = [tuple(record.get(key) for key in keys) for record in records]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))


def test_texts_that_hold_the_start_of_a_record(spark, tmp_path):
    """In one text, in many in a row, and in one that lies over several splits."""
    start = "{'business_id': "
    texts = [f"x {start}'b9', y", "plain", start * 3, 'say "no"', f"it's \\ {start}", "{'business_id", "\\"]
    records = [
        {"business_id": f"b{i}", "user_id": f"u{i}", "review_text": texts[i * i % 7]} for i in range(400)
    ]
    records[200]["review_text"] = (start + "a long text, ") * 1500
    (tmp_path / "in.txt").write_text(repr({"train": records[:250], "val": records[250:], "test": []}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(tmp_path / "in.txt")).rdd.getNumPartitions() >= 4
        reviews.literal_to_json_lines(spark, str(tmp_path / "in.txt"), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    rows = reviews.read_review_lines(spark, str(tmp_path / "out")).collect()
    found = sorted((r["business_id"], r["user_id"], r["review_text"]) for r in rows)
    assert found == sorted(tuple(record.values()) for record in records)


def test_ends_of_pieces(spark):
    assert not reviews.ends_in_text("'a', 'b': \"it's\"}, ", False)
    assert reviews.ends_in_text("'a', 'b': \"it's ", False)
    assert reviews.ends_in_text("no end \\\" here", True)
    assert not reviews.ends_in_text('end", \'say "no"\'}', True)
    assert not reviews.ends_in_text("'" + "long" * 100_000 + "'", False)


def test_printed_records_with_nested_pictures(spark, tmp_path):
    flat = [{"user_id": "u", "pics": [{"id": "x", "at": 1}, {"id": "y"}]}, {"user_id": "v"}]
    (tmp_path / "full.txt").write_text(repr(flat) + "\n")
    reviews.literal_to_json_lines(spark, str(tmp_path / "full.txt"), str(tmp_path / "out"))
    rows = reviews.read_review_lines(spark, str(tmp_path / "out"), "FULL").collect()
    assert sorted((row["user_id"], row["pics"]) for row in rows) == [("u", ["x", "y"]), ("v", None)]
    (tmp_path / "none.txt").write_text(repr({"train": [], "val": [], "test": []}))
    reviews.literal_to_json_lines(spark, str(tmp_path / "none.txt"), str(tmp_path / "none"))
    assert reviews.read_review_lines(spark, str(tmp_path / "none")).count() == 0


def test_literals_are_not_run(spark, tmp_path):
    (tmp_path / "bad.json").write_text("__import__('os').getcwd()\n")
    with pytest.raises(Exception):
        reviews.literal_to_json_lines(spark, str(tmp_path / "bad.json"), str(tmp_path / "out"))


def test_malformed_review_lines_are_errors(spark, tmp_path):
    (tmp_path / "lines").write_text('{"user_id": "a"}\n\n{"user_id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        reviews.read_review_lines(spark, str(tmp_path / "lines")).collect()
    (tmp_path / "fine").write_text('{"user_id": "a"}\n\n')
    assert reviews.read_review_lines(spark, str(tmp_path / "fine")).count() == 1


def test_flat_list_with_picture_structs(spark, tmp_path):
    text = '[{"business_id":"b","user_id":"u","rating":1,"pics":[{"id":"x"},{"id":"y"}]}]'
    (tmp_path / "full.json").write_text(text)
    row = reviews.read_review_file(spark, str(tmp_path / "full.json"), "FULL").first()
    assert (row["review_text"], row["pics"]) == (None, ["x", "y"])
    three = '{"train":[{"user_id":"a"}],"val":[{"user_id":"b"}],"test":[{"user_id":"c"}]}'
    (tmp_path / "filter.json").write_text(three)
    rows = reviews.read_review_file(spark, str(tmp_path / "filter.json")).collect()
    assert sorted(row["user_id"] for row in rows) == ["a", "b", "c"]


def test_encoded_and_typed_reviews(spark):
    df = spark.createDataFrame(
        [("y", "u", 3, None), ("x", "v", None, "t")],
        "business_id string, user_id string, rating int, review_text string",
    )
    typed = reviews.typed_reviews(reviews.encoded_reviews(df))
    assert typed.dtypes == [(f.name, f.dataType.simpleString()) for f in reviews.REVIEWS_SCHEMA]
    assert sorted(typed.collect(), key=str) == [(0, 1, None, "t"), (1, 0, 3, "_")]


def test_recipes_csv_with_line_ends_in_quotes(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        "name,id,tags,ingredients,description\n"
        "\"hot\npot\",1,['a'],\"['soup', 'bread']\",\"a \"\"good\"\" one\"\n"
    )
    rows = recipes.read_recipes(spark, str(tmp_path / "r.csv"))
    assert rows.columns == ["tags", "ingredients", "name", "description"]
    row = recipes.recipe_word_lists(rows, ["ingredients", "name"]).first()
    assert row["description"] == 'a "good" one'
    assert row["words"] == ["soup", "bread", "hot\npot"]


def test_one_quoted_csv_is_read_by_many_tasks(spark, tmp_path):
    """Line ends in quotes at any place, a record over several splits, as csv itself reads them."""
    cells = ["plain", "two\nlines", 'say ""no""', "", "a, b", "\n\n", "caf\u00e9\r\nx", '""', "end\n"]
    quoted = [f'"{c}"' if set(c) & set('\n",') else c for c in cells]
    lines = [f"{quoted[i % 9]},{i},{quoted[i * i % 7]},{quoted[(i + 4) % 9]}" for i in range(700)]
    lines[300] = '"' + "long\n" * 4000 + '",300,x,"y"'
    lines[450] = ""
    text = "name,id,description,tags\n" + "\n".join(lines) + "\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.csv").write_text(text, newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() >= 4
        rows = recipes.read_quoted_csv(spark, str(tmp_path / "in"), ["id", "name", "tags", "description"])
        found = sorted((int(r["id"]), r["name"], r["tags"], r["description"]) for r in rows.collect())
        (tmp_path / "in" / "open.csv").write_text('name,id\n"never closed,1\n')
        with pytest.raises(ValueError, match="close"):
            recipes.read_quoted_csv(spark, str(tmp_path / "in"), ["id"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    plain = [r for r in csv.reader(io.StringIO(text, newline="")) if r][1:]
    wanted = sorted((int(r[1]), r[0], r[3], r[2]) for r in plain)
    assert [tuple(c or "" for c in r[1:]) for r in found] == [r[1:] for r in wanted]
    assert [r[0] for r in found] == [r[0] for r in wanted]


def test_csv_files_without_rows_or_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"na\nme",id\n')
    assert recipes.read_quoted_csv(spark, str(tmp_path / "a.csv"), ["id", "na\nme"]).collect() == []
    (tmp_path / "b.csv").write_text("id\n1\n")
    with pytest.raises(ValueError, match="headers"):
        recipes.read_quoted_csv(spark, str(tmp_path / "[ab].csv"), ["id"])


def test_artefacts_round_trip(spark, tmp_path):
    lists = spark.createDataFrame([(["soup", "bread"], "soup bread"), (["soup"], "soup")], "words array<string>, text string")
    path = recipes.artefact_path(str(tmp_path), "tfidf", ["ingredients", "name"])
    assert path.endswith("tfidf_ingredients_name")
    vocab = build_vocabulary(lists, "text")
    saved = recipes.save_table(vocab, path)
    assert sorted(saved.collect()) == sorted(vocab.collect())
    model = learning.train_word_vectors(lists, "words", size=4)
    recipes.save_model(model, str(tmp_path / "w2v"))
    table = learning.model_vectors(recipes.load_word_vectors(str(tmp_path / "w2v")))
    assert sorted(row["word"] for row in table.collect()) == ["bread", "soup"]
    lexicon = spark.createDataFrame([("soup",)], "word string")
    chosen = vectors.lexicon_vectors(table, lexicon)
    wide = vectors.to_columns(chosen, 4)
    assert wide.columns == ["word", "v0", "v1", "v2", "v3"]
    assert vectors.to_array(wide, 4).collect() == chosen.collect()
