import math
import random

import pytest
from pyspark.sql import functions as F

from reviewloom.operators import ids, ordering, stats, words


def test_numbers_are_dense_in_order_with_many_equal_rows(spark):
    random.seed(1)
    values = [(0 if random.random() < 0.5 else random.randint(1, 500),) for _ in range(5000)]
    df = spark.createDataFrame(values, "x int").repartition(7)
    rows = ordering.numbered(df, ["x"], "i", start=10).orderBy("i").collect()
    assert [row["i"] for row in rows] == list(range(10, 5010))
    assert [row["x"] for row in rows] == sorted(x for (x,) in values)


def test_equal_rows_are_spread_over_partitions(spark):
    df = spark.range(4000).select(F.lit(1).alias("x")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = ordering._sorted_slots(df, ["x"], "test").groupBy("_part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(row["count"] for row in sizes) < 2000


def test_running_sums(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(1000)], "x int, n int").repartition(5)
    rows = ordering.running_sums(df, ["x"], {"before": F.col("n")}).orderBy("x").collect()
    total = 0
    for row in rows:
        assert row["before"] == total
        total += row["n"]


def test_codes_are_alphabetical_and_null_stays(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("C",)], "x string")
    codes = sorted((row["x"] for row in ids.encode_labels(df, "x").collect()), key=str)
    assert codes == [0, 1, 2, 2, None]


def test_review_ids_go_on_from_a_start(spark):
    reviews = spark.createDataFrame([("u", "b", "x"), ("a", "b", "x")], "user_id string, business_id string, review_text string")
    numbered = ids.add_review_ids(reviews, 7, reviews.columns)
    id_rows, texts = ids.split_ids_and_text(numbered)
    assert {(r["user_id"], r["review_id"]) for r in id_rows.collect()} == {("a", 7), ("u", 8)}
    assert texts.columns == ["review_id", "review_text"]


def ratings(spark, values):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "g int, i int, r int")


@pytest.mark.parametrize(
    "values, expected", [([4, 4, 4], [0, 0, 0]), ([3, None, 5], [-1, None, 1])]
)
def test_z_scores(spark, values, expected):
    rows = stats.group_z_scores(ratings(spark, values), "g", "r").orderBy("i").collect()
    assert [row["z"] for row in rows] == expected


def test_rows_without_group_have_no_z_score_and_ratio_zero(spark):
    df = spark.createDataFrame([(None, 1), (None, 3)], "g int, r int")
    assert [row["z"] for row in stats.group_z_scores(df, "g", "r").collect()] == [None, None]
    assert [row["ratio"] for row in stats.group_mean_ratios(df, "g", "r").collect()] == [0, 0]


def test_mean_ratios(spark):
    assert stats.group_mean_ratios(ratings(spark, [4]), "g", "r").first()["ratio"] == 0
    over_values = stats.group_mean_ratios(ratings(spark, [3, None, 5]), "g", "r").collect()
    assert [row["ratio"] for row in over_values] == [4, 4, 4]
    over_rows = stats.group_mean_ratios(ratings(spark, [3, None, 5]), "g", "r", all_rows=True)
    for row in over_rows.collect():
        assert row["ratio"] == pytest.approx(4 / math.sqrt(2 / 3))


def test_interactions(spark):
    pairs = [(b, u) for b in range(1, 12) for u in range(b)] * 2
    df = spark.createDataFrame(pairs, "business_id int, user_id int")
    row = stats.interaction_metrics(df, "business_id", "user_id").first()
    assert (row["entities"], row["max_size"], row["median_size"], row["mean_size"]) == (11, 11, 6, 6)
    bins = stats.interaction_histogram(df, "business_id", "user_id").orderBy("bin").collect()
    assert [(r["bin"], r["entities"]) for r in bins] == [(i, 1) for i in range(9)] + [(9, 2)]
    same = spark.createDataFrame([(1, 1), (2, 1)], "business_id int, user_id int")
    assert stats.interaction_histogram(same, "business_id", "user_id").collect() == [(5, 2)]


def test_confusion_keeps_empty_cells(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (1, 1)], "y int, p int")
    cells = {(r["truth"], r["predicted"]): r["share"] for r in stats.confusion_matrix(df, "y", "p").collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): pytest.approx(1 / 3), (1, 1): pytest.approx(2 / 3)}


def test_auc_equals_all_pairs(spark):
    random.seed(3)
    rows = [(random.randint(0, 1), random.randint(0, 20) / 20) for _ in range(300)]
    wins = [
        1.0 if p > n else 0.5 if p == n else 0.0
        for y, p in rows if y == 1 for z, n in rows if z == 0
    ]
    df = spark.createDataFrame(rows, "y int, s double")
    assert stats.area_under_roc(df, "y", "s").first()["auc"] == pytest.approx(sum(wins) / len(wins))


def test_double_singletons(spark):
    rows = [(1, "a", 1), (1, "b", 2), (2, "b", 3), (3, "c", 4), (4, "a", 5)]
    ids_ = spark.createDataFrame(rows, "user_id int, business_id string, review_id int")
    kept = words.drop_double_singletons(ids_).collect()
    assert sorted(row["review_id"] for row in kept) == [1, 2, 3, 5]
    once = words.values_seen_once(ids_, "user_id").collect()
    assert sorted(row["user_id"] for row in once) == [2, 3, 4]


def test_row_numbers_as_read(spark):
    rows = spark.range(100, numPartitions=7).select((F.col("id") * 37 % 100).alias("x"), F.lit("t").alias("text"))
    numbered = ids.add_review_ids(rows, start=5).collect()
    assert [(r["x"], r["review_id"]) for r in sorted(numbered, key=lambda r: r["review_id"])] == [
        (i * 37 % 100, i + 5) for i in range(100)
    ]
    assert ids.add_review_ids(rows.limit(0)).count() == 0
