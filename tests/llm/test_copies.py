"""One row of each group of near-copies, by row and by exact shingles."""

import random

from reviewloom.llm import shingles, simhash


def words(seed, number):
    draw = random.Random(seed)
    return [f"w{draw.randrange(5000)}" for _ in range(number)]


def test_rows_without_a_key_or_with_a_repeated_one(spark):
    a, b, c, d = (" ".join(words(seed, 60)) for seed in range(4))
    rows = [(1, a), (None, a), (None, b), (None, b), (None, c), (5, a), (5, d), (7, d)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted(((r.doc_id or 0), r.text) for r in simhash.one_of_each(docs).collect())
    # Two texts under key 5: one is a copy of key 1, the other stays for itself and key 7.
    assert found == sorted([(1, a), (0, b), (0, c), (5, d)])


def test_edited_copies_and_chains_from_similarity_08(spark):
    draw = random.Random(9)
    texts = [words(seed, 300) for seed in range(100, 140)]
    # Edited words of each text: five shingles each, so similarity from about 0.75 to 0.99.
    for text in texts[:40]:
        edited = list(text)
        for at in draw.sample(range(300), draw.randint(1, 8)):
            edited[at] = f"x{draw.randrange(10**6)}"
        texts.append(edited)
    # A chain, whose ends are not similar, and a large group around one text.
    chain = words(7, 300)
    for step in range(6):
        chain = chain[:]
        chain[step * 40 : step * 40 + 20] = words(1000 + step, 20)
        texts.append(chain)
    middle = words(8, 300)
    for step in range(60):
        edited = list(middle)
        edited[draw.randrange(300)], edited[draw.randrange(300)] = f"y{step}", f"z{step}"
        texts.append(edited)
    sets = [{" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id bigint, text string")
    rows = simhash.numbered(docs)
    found = simhash.first_of_each(rows, shingles.linked(rows, simhash.ROW))
    assert sorted(r.doc_id for r in found.collect()) == sorted(set(root))
    assert shingles.linked(simhash.numbered(docs.limit(0)), simhash.ROW).count() == 0
