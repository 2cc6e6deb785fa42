"""From the raw files to scored pairs, as the README shows it."""

import random
from dataclasses import replace
from pathlib import Path

import pytest

from reviewloom.operators.durable import remove_stored, stored
from reviewloom.plans.from_files import Files, evaluated, learned, numbered_reviews, reported
from reviewloom.plans.preparation import Settings, prepare

FOODS = ["soup", "bread", "salad", "pizza", "pasta", "rice", "curry", "beans", "fish", "cake"]


def test_from_files_to_scores(spark, tmp_path):
    random.seed(5)
    lines = ["name,ingredients"]
    for _ in range(60):
        some = random.sample(FOODS, 3)
        lines.append(f"{some[0]} {some[1]},\"{some}\"")
    (tmp_path / "recipes.csv").write_text("\n".join(lines) + "\n")
    records = [
        {
            "business_id": f"b{random.randint(0, 9)}",
            "user_id": f"u{random.randint(0, 14)}",
            "rating": random.randint(1, 5),
            "review_text": "The " + ", ".join(random.choices(FOODS, k=5)) + "!",
        }
        for _ in range(80)
    ] + [{"business_id": "b1", "user_id": "u1"}]
    (tmp_path / "reviews.txt").write_text(repr({"train": records, "val": [], "test": []}))

    files = Files(
        str(tmp_path / "recipes.csv"), str(tmp_path / "reviews.txt"), str(tmp_path), settings=Settings(vector_size=6)
    )
    vocabulary, word_vectors = learned(spark, files)
    assert {row["word"] for row in vocabulary.collect()} == set(FOODS)
    assert {row["word"] for row in word_vectors.collect()} == set(FOODS)

    loaded = replace(files, recipes="", fit=False)
    reviews = numbered_reviews(spark, files)
    assert sorted(row["review_id"] for row in reviews.collect()) == list(range(81))
    prepared = prepare(reviews, vocabulary, word_vectors, files.settings)
    assert prepared.users.count() == len({r["user_id"] for r in records})
    seen = prepared.seen.count()
    assert prepared.unseen.count() == seen

    found = evaluated(spark, loaded)
    scored = found.scored.collect()
    assert len(scored) == -(-2 * seen // 4)
    assert {row["predicted"] for row in scored} <= {0, 1}
    # The cells of each class add up to the validation rows of the class.
    cells = found.confusion.collect()
    for y in (0, 1):
        assert sum(c["rows"] for c in cells if c["truth"] == y) == sum(row["y"] == y for row in scored)
    report = reported(spark, loaded, "business", 3, top=8).collect()
    words = [word for row in report for word in row["words"]]
    assert len(words) == len(set(words)) <= 8 and set(words) <= set(FOODS)
    assert sorted(row["arg_position"] for row in report) == sorted({row["arg_position"] for row in report})
    fewer = replace(files, kept=str(tmp_path / "fewer"), stop_words=("soup",), max_df=0.9)
    assert {row["word"] for row in learned(spark, fewer)[0].collect()} == set(FOODS) - {"soup"}

    pairs = [(a["score"], b["score"]) for a in scored for b in scored if a["y"] > b["y"]]
    wins = sum((a > b) + (a == b) / 2 for a, b in pairs)
    assert found.auc.first()["auc"] == pytest.approx(wins / len(pairs))


def test_written_tables_can_be_removed(spark):
    table = stored(spark.range(3), "three")
    assert table.count() == 3
    path = Path(table.inputFiles()[0].removeprefix("file://")).parent
    beside = path.parent.parent / "another"
    beside.mkdir()
    try:
        remove_stored(spark)
        assert not path.exists() and beside.exists()
    finally:
        beside.rmdir()
    assert stored(spark.range(2), "again").count() == 2
