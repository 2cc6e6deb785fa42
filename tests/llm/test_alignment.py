"""Aligned tokens against a plain restatement over bytes."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from reviewloom.llm import alignment
from reviewloom.llm.encoders import ByteEncoder
from reviewloom.llm.queries import QUERIES, tokenizer_files

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    whole = Tokenizer.from_file(tokenizer_files()["tokenizer"])
    whole.encode_special_tokens = True
    return whole, SentencePieceProcessor(model_file=MODEL)


def spans(tokens):
    at, found = 0, []
    for number, content in tokens:
        found.append((at, at + len(content), number))
        at += len(content)
    return found


def plain(texts, tokenizers):
    whole, pieces = tokenizers
    own = ByteEncoder(tokenizer_files()["tokenizer"]).token_bytes()
    rows, links = [], []
    for text in texts:
        full = (" " + (text or "")).encode()
        a = [(i, own[i]) for i in whole.encode(full.decode(), add_special_tokens=False).ids]
        b = []
        for i in pieces.encode(text or ""):
            piece = pieces.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()))
        fine = bool(text) and all(b"".join(x for _, x in side) == full for side in (a, b))
        a, b = (spans(side) if fine else [] for side in (a, b))
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, linked, i, j = [], [], 0, 0
        for cut in cuts:
            k, m = (next(n + 1 for n in range(at, len(side)) if side[n][1] == cut) for side, at in ((a, i), (b, j)))
            groups.append("|".join(",".join(str(x) for *_, x in side) for side in (a[i:k], b[j:m])))
            linked += [(x, y) for s, e, x in a[i:k] for u, v, y in b[j:m] if s < v and u < e]
            i, j = k, m
        links.append(linked)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        rows.append([len(a), len(b), len(groups), len(linked), digest])
    count = Counter(pair for linked in links for pair in linked)
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    for row, linked in zip(rows, links, strict=True):
        row[4:4] = [sum(count[x] == most[x[1]] for x in linked), sum(count[x] for x in linked)]
    return [tuple(row) for row in rows]


HARD = [
    None, "", " ", "  ", "a", "a  b", "\n", "\t\tx", "▁", "a▁b", "<s>", "</s> x", "<|endoftext|>", "<0x41>", "<unk>",
    "中文字", "é́ﬁ①", "😀 x😀", "a\x00b", "naïve naïve", "word " * 400, "x" * 700, " lead", "trail ", "ᚠᚢ", "a b",
]


def result(spark, rows, schema="doc_id bigint, text string", **more):
    table = spark.createDataFrame(rows, schema)
    return alignment.alignments(table, model=MODEL, **tokenizer_files(), **more).collect()


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 8, 0])
def test_equals_plain_bytes(spark, tokenizers, frequent):
    found = {r.doc_id: tuple(r)[1:] for r in result(spark, list(enumerate(HARD)), frequent=frequent)}
    assert [found[n] for n in range(len(HARD))] == plain(HARD, tokenizers)


def test_query_on_a_whole_table(spark, folder, tokenizers):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_cross_tokenizer"](spark, folder).collect()}
    short = [(r.doc_id, r.text) for r in docs]
    expected = plain([text for _, text in short], tokenizers)
    assert [found[key] for key, _ in short] == expected


def test_odd_tables(spark):
    assert result(spark, []) == []
    rows = [(None, "a b", 1, "x"), (5, "a b", 2, "y"), (5, None, None, None)]
    found = result(spark, rows, "doc_id bigint, text string, row int, pairs string")
    assert sorted((r.doc_id is None, r.n_a) for r in found) == [(False, 0), (False, 2), (True, 2)]


def test_both_encoders_agree_below_the_border():
    encode = ByteEncoder(**tokenizer_files())
    plain_one = ByteEncoder(tokenizer_files()["tokenizer"])
    assert plain_one.token_bytes()[:50256] == encode.token_bytes()
    for code in range(0x250):
        for text in (chr(code), f"a{chr(code)}b", f" {chr(code)} 1", f"x{chr(code)}{chr(code)} "):
            assert encode.ids(text) == plain_one.ids(text)
