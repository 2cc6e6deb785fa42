import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.functions import vectors as V
from reviewloom.operators import entity_vectors as E
from reviewloom.operators import groups, learning, sampling, similarity, stats, tfidf
from reviewloom.operators.durable import stored
from reviewloom.operators.ordering import preceding

SIZE = 3
REVIEWS = [  # user, business, review, words
    (1, "a", 1, "soup soup bread"),
    (1, "b", 2, "bread salad"),
    (2, "b", 3, "salad soup"),
    (2, "a", 4, "bread"),
    (3, "a", 5, "salad salad"),
]
VECTORS = {"soup": [1.0, 0.0, 2.0], "bread": [0.0, 1.0, -1.0], "salad": [3.0, 1.0, 0.5]}


@pytest.fixture(scope="module")
def counts(spark):
    rows = [
        (u, b, r, w, text.split().count(w)) for u, b, r, text in REVIEWS for w in set(text.split())
    ]
    return spark.createDataFrame(
        rows, "user_id int, business_id string, review_id int, word string, n bigint"
    )


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(list(VECTORS.items()), "word string, vec array<double>")


def expected_weights(side):
    """TF-IDF by the formula, in plain Python."""
    texts = {}
    for review in REVIEWS:
        texts.setdefault(review[side], []).extend(review[3].split())
    n = len(texts)
    df = {w: sum(w in words for words in texts.values()) for w in VECTORS}
    weights = {}
    for key, words in texts.items():
        raw = {w: words.count(w) * (math.log((1 + n) / (1 + df[w])) + 1) for w in set(words)}
        length = math.sqrt(sum(r * r for r in raw.values()))
        weights[key] = {w: r / length for w, r in raw.items()}
    return weights


def expected_mean(reviews, side, mode):
    weights = expected_weights(side)
    total, weight = np.zeros(SIZE), 0.0
    for review in reviews:
        for word in review[3].split():
            w = 1.0 if mode == "plain" else weights[review[side]][word]
            total += np.array(VECTORS[word]) * (w if mode == "weighted" else 1.0)
            weight += w
    return total / weight


MODES = {
    "plain": E.Weighting(with_tfidf=False),
    "tfidf": E.Weighting(),
    "weighted": E.Weighting(weighted_vectors=True),
}


@pytest.mark.parametrize("mode", MODES)
def test_entity_vectors_and_leave_one_out(spark, counts, vectors, mode):
    sums = E.review_sums(counts, vectors, SIZE, MODES[mode])
    for side, entity in enumerate(E.ENTITIES):
        means = {r[0]: r[1] for r in E.entity_means(sums, entity).collect()}
        assert set(means) == {review[side] for review in REVIEWS}
        for key, mean in means.items():
            own = [review for review in REVIEWS if review[side] == key]
            assert mean == pytest.approx(expected_mean(own, side, mode))
    rows = {r["review_id"]: r for r in E.leave_one_out(sums).collect()}
    assert set(rows) == {1, 2, 3, 4}  # user 3 has a single review
    for review in REVIEWS[:4]:
        for side, entity in enumerate(E.ENTITIES):
            others = [r for r in REVIEWS if r[side] == review[side] and r is not review]
            assert rows[review[2]][f"{entity}_vec"] == pytest.approx(expected_mean(others, side, mode))


def test_own_and_others_add_up(spark, counts, vectors):
    sums = E.review_sums(counts, vectors, SIZE)
    totals = {r["user_id"]: r for r in E.entity_sums(sums, "user").collect()}
    loo = {r["review_id"]: r["user_vec"] for r in E.leave_one_out(sums, ["user"]).collect()}
    for row in sums.rows.collect():
        if row["review_id"] in loo:
            total = totals[row["user_id"]]
            own_weight = row["user_weight"] / total["length"]
            others = np.array(loo[row["review_id"]]) * (total["weight"] - own_weight)
            assert np.array(row["vec"]) + others == pytest.approx(np.array(total["vec"]), abs=1e-9)


def test_word_level(spark, counts, vectors):
    rows = E.word_level(counts, vectors, "business").collect()
    weights = expected_weights(1)
    assert len(rows) == counts.count()
    for row in rows:
        assert row["weight"] == pytest.approx(weights[row["business_id"]][row["word"]])
        assert row["vec"] == VECTORS[row["word"]]
    assert {r["weight"] for r in E.word_level(counts, vectors, "user", False).collect()} == {1.0}


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(
        V.unit(F.col("a")).alias("unit"),
        V.unit(F.col("b")).alias("none"),
        V.pair_concat(F.col("a"), F.col("b")).alias("both"),
        V.pair_product(F.col("a"), F.col("a")).alias("product"),
        V.scale(F.col("a"), F.lit(2.0)).alias("scaled"),
        V.zero_if_not_finite(F.try_divide(F.lit(1.0), F.lit(0.0))).alias("zero"),
        V.zero_if_not_finite(F.lit(float("-inf"))).alias("infinite"),
    ).first()
    assert row["unit"] == pytest.approx([0.6, 0.8])
    assert row["none"] == [None, None]
    assert row["both"] == [3.0, 4.0, 0.0, 0.0]
    assert row["product"] == pytest.approx([0.36, 0.64])
    assert row["scaled"] == [6.0, 8.0]
    assert row["zero"] == row["infinite"] == 0.0


def test_analogy(spark):
    table = {"man": [1.0, 0.0], "king": [1.0, 1.0], "woman": [0.0, 1.0], "queen": [0.0, 2.0], "dog": [-1.0, 0.1]}
    vectors = spark.createDataFrame(list(table.items()), "word string, vec array<double>")
    rows = similarity.analogy(vectors, "man", "king", "woman", 2, top=1).collect()
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    query = unit((unit(table["king"]) + unit(table["woman"]) - unit(table["man"])) / 3)
    assert rows[0]["word"] == "queen"
    assert rows[0]["similarity"] == pytest.approx(float(unit(table["queen"]) @ query))
    assert similarity.analogy(vectors, "man", "king", "nobody", 2).collect() == []


@pytest.mark.parametrize(("in_block", "in_slot"), [(1, 1), (2, 3), (1000, 1000)])
def test_analogies_over_blocks_and_slots(spark, monkeypatch, in_block, in_slot):
    monkeypatch.setattr(similarity, "QUESTIONS_IN_BLOCK", in_block)
    monkeypatch.setattr(similarity, "WORDS_IN_SLOT", in_slot)
    draw = random.Random(4)
    rows = [(f"w{n}", [draw.gauss(0, 1) for _ in range(3)]) for n in range(40)]
    # Equal vectors go by the word; the last four words cannot be compared.
    rows += [(f"x{n}", rows[7][1]) for n in range(12)]
    rows += [("zero", [0.0] * 3), ("short", [1.0]), ("gap", [1.0, None, 2.0]), ("none", None), (None, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame(rows, "word string, vec array<double>")
    asked = [(1, "w1", "w2", "w3"), (2, "w7", "x3", "w9"), (3, "w1", "w1", "w2"), (4, "w1", "zero", "w2")]
    asked += [(5, "w1", None, "w2"), (6, "w4", "nobody", "w5"), (7, "w30", "w7", "x11")]
    questions = spark.createDataFrame(asked, "question bigint, base string, version string, target string")
    table = similarity.analogies(vectors, questions, 3, top=9)
    found = sorted((r.question, r["rank"], r.word, round(r.similarity, 9)) for r in table.collect())
    units = {}
    for word, vec in rows[:52]:
        units[word] = [x / math.sqrt(sum(y * y for y in vec)) for x in vec]
    expected = []
    for key, base, version, target in (asked[0], asked[1], asked[6]):
        mean = [b + c - a for a, b, c in zip(units[base], units[version], units[target], strict=True)]
        norm = math.sqrt(sum(x * x for x in mean))
        scored = [
            (-round(sum(x * y for x, y in zip(vec, mean, strict=True)) / norm, 9), word)
            for word, vec in units.items()
            if word not in (base, version, target)
        ]
        expected += [(key, n, word, -s) for n, (s, word) in enumerate(sorted(scored)[:9], 1)]
    assert found == sorted(expected)
    assert similarity.analogies(vectors, questions.limit(0), 3).count() == 0
    assert similarity.analogies(vectors.limit(0), questions, 3).count() == 0


@pytest.mark.parametrize("in_block", [1, 3, 100])
def test_nearest_centre_over_blocks(spark, monkeypatch, in_block):
    monkeypatch.setattr(similarity, "CENTRES_IN_BLOCK", in_block)
    centres = spark.createDataFrame([(n, [float(10 * n)]) for n in range(8)], "centre int, vec array<double>")
    points = spark.createDataFrame([(n, [10.0 * n + 4]) for n in range(8)], "id int, point array<double>")
    rows = similarity.nearest_centre(points, "point", centres).collect()
    assert {r["id"]: r["centre"] for r in rows} == {n: n for n in range(8)}


def test_split_with_a_null_class(spark):
    rows = [(n, [None, "a", "b"][n % 3]) for n in range(120)]
    table = spark.createDataFrame(rows, "id int, y string")
    held = sampling.stratified_split(table, "y", "id").where("held_out").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in held} == {None: 10, "a": 10, "b": 10}


def test_a_review_without_partner_counts_for_its_own_side(spark):
    counts = spark.createDataFrame(
        [(1, "x", 1, 0, 1), (1, None, 2, 1, 1), (1, "x", 3, 0, 1), (None, "x", 4, 1, 1)],
        "user_id int, business_id string, review_id int, word int, n int",
    )
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "word int, vec array<double>")
    for plain in (True, False):
        sums = E.review_sums(counts, vectors, 2, E.Weighting(with_tfidf=not plain))
        found = {e: E.entity_means(sums, e).collect() for e in ("user", "business")}
        if plain:
            for rows in found.values():
                assert rows[0][1] == pytest.approx([2 / 3, 1 / 3])
        assert all(len(rows) == 1 and rows[0][1][1] > 0 for rows in found.values())
        left = E.leave_one_out(sums).collect()
        assert sorted(r["review_id"] for r in left) == [1, 3]


def test_spread_of_equal_weights_is_nothing(spark):
    flat = [("flat", f"l{n}", 0.3) for n in range(7)]
    bent = [("bent", f"l{n}", 0.3 + (1e-9 if n == 3 else 0)) for n in range(7)]
    one = [("one", "l2", 1.0)]
    weights = spark.createDataFrame(flat + bent + one, "word string, label string, weight double")
    positions = spark.createDataFrame([(f"l{n}", n) for n in range(7)], "label string, position bigint")
    words = spark.createDataFrame([("flat",), ("bent",), ("one",), ("none",)], "word string")
    found = {r["word"]: r["stdev"] for r in tfidf.word_labels(weights, "label", stored(positions, "p"), words).collect()}
    assert found["flat"] == found["none"] == 0
    assert found["bent"] == pytest.approx(1e-9 * np.sqrt(6) / 7, rel=1e-3)
    assert found["one"] == pytest.approx(np.sqrt(6) / 7)


def test_unseen_pairs(spark):
    rows = [(i, f"u{i % 7}", f"b{(i * i) % 11}") for i in range(60)]
    seen = spark.createDataFrame(rows, "review_id int, user_id string, business_id string")
    pairs = sampling.unseen_pairs(seen).collect()
    known = {(u, b) for _, u, b in rows}
    assert len(pairs) == len(rows)
    assert not known & {(p["user_id"], p["business_id"]) for p in pairs}
    assert len({p["candidate"] for p in pairs}) == len(pairs)
    again = sampling.unseen_pairs(seen.repartition(5)).collect()
    assert sorted(pairs) == sorted(again)


def test_no_unseen_pair_is_an_error(spark):
    seen = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "review_id int, user_id int, business_id int")
    with pytest.raises(ValueError):
        sampling.unseen_pairs(seen)
    assert sampling.unseen_pairs(seen.limit(0)).count() == 0


def test_unseen_pairs_of_a_dense_table(spark):
    """All pairs but two are seen; the user of one of them comes up ten times as often."""
    rows = [(u, b) for u in range(40) for b in range(40) if (u, b) not in ((3, 5), (7, 9))]
    rows += [(3, 0)] * 351
    seen = spark.createDataFrame(
        [(n, u, f"b{b}") for n, (u, b) in enumerate(rows)], "review_id int, user_id int, business_id string"
    )
    found = sampling.unseen_pairs(seen).collect()
    drawn = [(r["user_id"], r["business_id"]) for r in found]
    assert sorted(r["candidate"] for r in found) == list(range(len(rows)))
    assert set(drawn) == {(3, "b5"), (7, "b9")}
    assert drawn.count((3, "b5")) / len(drawn) == pytest.approx(10 / 11, abs=0.03)
    assert sorted(found) == sorted(sampling.unseen_pairs(seen.repartition(3)).collect())


def test_draws_go_with_the_numbers_of_rows(spark):
    """Most pairs are seen; each pair left comes up as often as the product of its counts says."""
    times = {(u, b): 1 + (u * 7 + b * 3) % 5 for u in range(12) for b in range(9) if (u * 5 + b) % 10}
    times[0, 1] = 4000
    rows = [(u, f"b{b}") for (u, b), n in times.items() for _ in range(n)]
    seen = spark.createDataFrame([*rows, (None, "b1"), (3, None)], "user_id int, business_id string")
    found = sampling.unseen_pairs(seen).collect()
    assert sorted(r["candidate"] for r in found) == list(range(len(rows)))
    users, businesses = Counter(u for u, _ in rows), Counter(b for _, b in rows)
    weights = {
        (u, b): users[u] * businesses[b] for u in users for b in businesses if (u, b) not in set(rows)
    }
    drawn = Counter((r["user_id"], r["business_id"]) for r in found)
    assert set(drawn) <= set(weights)
    whole = sum(weights.values())
    for pair, weight in weights.items():
        assert drawn[pair] / len(found) == pytest.approx(weight / whole, abs=0.03)


def test_draws_equal_a_plain_walk_over_the_lines(spark):
    """The same points, walked along both lines without Spark."""
    rows = [(f"u{(i * i) % 13}", (i * 31) % 17 % 8) for i in range(90)]
    seen = spark.createDataFrame(rows, "user_id string, business_id int")
    users, businesses = Counter(u for u, _ in rows), Counter(b for _, b in rows)
    left = [(u, b) for u in sorted(users) for b in sorted(businesses) if (u, b) not in set(rows)]
    whole = sum(users[u] * businesses[b] for u, b in left)

    def digits(n, salt):
        return int(hashlib.md5(f"{n}:{salt}".encode()).hexdigest()[:12], 16)

    wanted = []
    for n in range(len(rows)):
        point = ((digits(n, "u") << 48) + digits(n, "b")) % whole
        for user in sorted(users):
            free = [b for b in sorted(businesses) if (user, b) not in set(rows)]
            own = users[user] * sum(businesses[b] for b in free)
            if point < own:
                step = point // users[user]
                break
            point -= own
        for business in free:
            if step < businesses[business]:
                break
            step -= businesses[business]
        wanted.append((n, user, business))
    found = sampling.unseen_pairs(seen, hashed=sampling.spread_hash).collect()
    assert sorted(map(tuple, found)) == wanted


def test_rows_before_are_carried_over_partitions(spark):
    rows = spark.range(1000).select((F.col("id") % 300).alias("a"), F.col("id").alias("b"))
    found = preceding(rows.repartition(7), ["a", "b"], {"old": F.col("b")}).collect()
    order = sorted((r["a"], r["b"], r["old"]) for r in found)
    assert [r[2] for r in order] == [None, *[r[1] for r in order[:-1]]]


def test_split_with_many_classes(spark):
    """Every class has a quota of its own; no class is named in the plan."""
    classes = 20_000
    rows = spark.range(3 * classes + 9).select(
        F.col("id").alias("key"),
        F.when(F.col("id") < 3 * classes, (F.col("id") % classes).cast("string")).alias("y"),
    )
    held = sampling.stratified_split(rows, "y", "key").groupBy("y").agg(
        F.count("*").alias("n"), F.sum(F.col("held_out").cast("int")).alias("held")
    )
    found = held.agg(F.sum("held"), F.max("held"), F.count("*")).first()
    null = held.where("y is null").first()
    assert found[0] == math.ceil((3 * classes + 9) * 0.25)
    assert null["n"] == 9 and null["held"] in (2, 3) and found[2] == classes + 1
    assert held.where("y is not null and held > 1").count() == 0


def test_split_of_nothing(spark):
    empty = spark.createDataFrame([], "key int, y string")
    assert sampling.stratified_split(empty, "y", "key").collect() == []


def test_split_is_exact_per_class(spark):
    rows = [(i, "a" if i % 5 else "b") for i in range(203)]
    df = spark.createDataFrame(rows, "key int, y string")
    split = sampling.stratified_split(df, "y", "key").collect()
    held = [r["y"] for r in split if r["held_out"]]
    assert len(split) == 203 and len(held) == math.ceil(203 * 0.25)
    assert abs(held.count("b") - 41 * 0.25) < 1
    again = sampling.stratified_split(df.repartition(6), "y", "key").collect()
    assert sorted(split) == sorted(again)


@pytest.mark.parametrize("balanced", [True, False])
def test_logistic_regression_is_the_exact_minimum(spark, balanced):
    draw = np.random.default_rng(5)
    given = draw.normal(0, [1.0, 5.0, 0.2], (400, 3))
    y = (given @ [1.5, -0.4, 2.0] - 1.0 + draw.logistic(0, 1, 400) > 0).astype(int)
    rows = [(int(a), x.tolist()) for a, x in zip(y, given, strict=True)] + [(None, [1.0, 1.0, 1.0])]
    df = learning.with_features(spark.createDataFrame(rows, "y int, x array<double>"), F.col("x"))
    model = learning.fit_logistic_regression(df.repartition(5), c=0.7, balanced=balanced)
    weight = np.where(y == 1, 200 / y.sum(), 200 / (400 - y.sum())) if balanced else np.ones(400)
    wide = np.column_stack([given, np.ones(400)])
    b, penalty = np.zeros(4), np.array([1.0, 1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-wide @ b))
        slope = 0.7 * wide.T @ (weight * (p - y)) + penalty * b
        b -= np.linalg.solve(0.7 * wide.T @ (wide * (weight * p * (1 - p))[:, None]) + np.diag(penalty), slope)
    np.testing.assert_allclose([*model.coefficients, model.intercept], b, atol=1e-6)
    scored = learning.scores(model, df.where("y is not null")).select("x", "score", "predicted").collect()
    for row in scored:
        chance = 1 / (1 + math.exp(-(sum(i * j for i, j in zip(row.x, b, strict=False)) + b[3])))
        assert row.score == pytest.approx(chance, abs=1e-6)
    assert learning.fit_logistic_regression(df.limit(0)) == learning.LogisticModel((), 0.0)


def test_classifiers_learn_planted_classes(spark):
    rng = np.random.default_rng(1)
    rows = [
        (i, int(i % 3 == 0), [float(x) for x in rng.normal(2.0 * (i % 3 == 0), 1.0, 4)])
        for i in range(400)
    ]
    df = learning.with_features(
        spark.createDataFrame(rows, "key int, y int, x array<double>"), F.col("x")
    )
    for model in (
        learning.fit_logistic_regression(df),
        learning.fit_neural_network(df, 4, hidden=(5,), max_iter=30),
    ):
        scored = learning.scores(model, df)
        assert stats.area_under_roc(scored, "y", "score").first()["auc"] > 0.8
    weights = learning.balance_weights(df).groupBy("y").agg(F.sum("class_weight").alias("w"))
    assert {round(r["w"]) for r in weights.collect()} == {200}


def test_groups_are_nearest_and_components_are_centred(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(10.0 * (i % 3), 1.0, 3)]) for i in range(150)]
    df = learning.with_features(spark.createDataFrame(rows, "i int, x array<double>"), F.col("x"))
    model = learning.fit_groups(df, 3)
    centres = np.array(model.clusterCenters())
    for row in learning.assign_groups(model, df).collect():
        gaps = ((centres - np.array(row["x"])) ** 2).sum(axis=1)
        assert row["group"] == int(gaps.argmin())
    placed = learning.fit_components(df, 2).transform(df).select("components").collect()
    points = np.array([row["components"].toArray() for row in placed])
    assert points.mean(axis=0) == pytest.approx([0.0, 0.0], abs=1e-8)


def test_word_labels_count_empty_cells(spark):
    weights = spark.createDataFrame(
        [("x", "soup", 0.8), ("y", "soup", 0.2), ("y", "bread", 0.5)], "label string, word string, weight double"
    )
    positions = spark.createDataFrame([("y", 0), ("x", 1), ("z", 2)], "label string, position bigint")
    vocab = spark.createDataFrame([("soup",), ("bread",), ("rare",)], "word string")
    rows = {r["word"]: r for r in tfidf.word_labels(weights, "label", positions, vocab).collect()}
    assert (rows["soup"]["arg_position"], rows["soup"]["arg_label"]) == (1, "x")
    assert rows["soup"]["stdev"] == pytest.approx(float(np.std([0.2, 0.8, 0.0])))
    assert rows["bread"]["stdev"] == pytest.approx(float(np.std([0.5, 0.0, 0.0])))
    assert (rows["rare"]["arg_label"], rows["rare"]["stdev"]) == ("y", 0.0)
    top = tfidf.top_words(tfidf.word_labels(weights, "label", positions, vocab), 2)
    lists = {r["arg_label"]: r["words"] for r in tfidf.keywords_per_label(top).collect()}
    assert lists == {"x": ["soup"], "y": ["bread"]}


def test_group_keywords(spark, counts):
    grouped = spark.createDataFrame([(1, 7.0), (2, 7.0), (3, 4.0)], "user_id int, group double")
    vocab = counts.select("word").distinct()
    rows = {r["word"]: r for r in groups.group_keywords(counts, grouped, vocab, "user").collect()}
    assert set(rows) == set(VECTORS)
    assert (rows["salad"]["arg_label"], rows["salad"]["arg_position"]) == (4, 1)
    assert (rows["soup"]["arg_label"], rows["soup"]["arg_position"]) == (7, 0)
