"""Tokens of two tokenizers, aligned by the bytes they cover.

Both token rows of a text cover the same bytes. All tokens, of both rows and of many texts at
a time, are sorted by their start; the running maximum of their ends says how far the tokens
so far reach, and a group ends where the next start is not before that. Within a group every
token of the one row expands to the tokens of the other that it overlaps.

How often two ids are linked is counted over the whole corpus. Most links are of few pairs of
ids, so the most frequent pairs, at most ``FREQUENT``, travel to the documents as one array;
only the links of rarer pairs are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import parts, slices, text_of
from reviewloom.llm.encoders import ByteEncoder, PieceEncoder
from reviewloom.operators.durable import stored

# Pairs of ids whose counts are broadcast: 12 bytes each, whatever the corpus.
FREQUENT = 1 << 20
# Distinct pairs that a task gathers before it hands their counts on.
_GATHERED = 1 << 20
_MARKS = (b",", b"|", b";")


@dataclass
class Aligned:
    """Of the texts of a slice: groups in all, and per link the indices of its two tokens."""

    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def _reach(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def aligned(size_a: np.ndarray, size_b: np.ndarray) -> Aligned:
    """Align two rows of tokens, given by their sizes in bytes, that cover the same bytes."""
    (start_a, end_a), (start_b, end_b) = _reach(size_a), _reach(size_b)
    starts, ends = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    group = np.zeros(len(order), np.int64)
    group[order[1:]] = np.cumsum(starts[order][1:] >= reached[:-1])
    first = np.searchsorted(end_b, start_a, "right")
    number = np.searchsorted(start_b, end_a, "left") - first
    link_a = np.repeat(np.arange(len(size_a)), number)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(first, number)
    return Aligned(group[: len(size_a)], group[len(size_a) :], link_a, link_b)


class _Texts:
    """Aligns the texts of a slice; made anew for each task."""

    def __init__(self, tokenizer: str, ranks: str | None, model: str):
        self.a, self.b = ByteEncoder(tokenizer, ranks), PieceEncoder(model)
        self.bytes_a, self.bytes_b = self.a.token_bytes(), self.b.token_bytes()
        self.sizes_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int64)
        most = max(self.a.size, self.b.size)
        self.listed = np.array([b"%d%s" % (n, mark) for mark in _MARKS for n in range(most)], object)
        self.most = most

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both rows; none where a row does not give back a space and the text."""
        if not text:
            return [], []
        whole = " " + text
        a, b, plain = self.a.ids(whole), self.b.ids(text), whole.encode("utf-8", "surrogatepass")
        if b"".join(map(self.bytes_a.__getitem__, a)) != plain or b"".join(map(self.bytes_b.__getitem__, b)) != plain:
            return [], []
        return a, b

    def __call__(self, texts: list[str]) -> dict[str, list]:
        both = [self.tokens(text) for text in texts]
        n_a, n_b = (np.array([len(x[k]) for x in both], np.int64) for k in (0, 1))
        a, b = (np.array([i for x in both for i in x[k]], np.int64) for k in (0, 1))
        found = aligned(self.sizes_a[a], self.sizes_b[b])
        text_a = np.repeat(np.arange(len(texts)), n_a)
        links = np.bincount(text_a[found.link_a], minlength=len(texts))
        # Where a row has tokens its first one opens a group, so groups lie within texts.
        opens = np.concatenate([[True], found.group_a[1:] != found.group_a[:-1]]) if len(a) else np.zeros(0, bool)
        groups = np.bincount(text_a[opens], minlength=len(texts))
        # Which pairs of ids a text links, and how often.
        space = self.a.size * self.b.size
        pair = text_a[found.link_a] * space + a[found.link_a] * self.b.size + b[found.link_b]
        pair, often = np.unique(pair, return_counts=True)
        ends = np.searchsorted(pair, np.arange(1, len(texts) + 1) * space)
        pair %= space
        cuts = list(zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True))
        return {
            "n_a": n_a.tolist(),
            "n_b": n_b.tolist(),
            "n_groups": groups.tolist(),
            "n_links": links.tolist(),
            "groups_sha256": self._digests(a, b, n_a + n_b, found),
            "pairs": [pair[s:e].astype("<u4" if space <= 1 << 32 else "<u8").tobytes() for s, e in cuts],
            "often": [often[s:e].astype("<u4").tobytes() for s, e in cuts],
        }

    def _digests(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, found: Aligned) -> list[str]:
        """Of each text the hash of its groups as text: ``a1,a2|b1;a3|b2,b3``."""
        place_a = np.arange(len(a)) + np.searchsorted(found.group_b, found.group_a, "left")
        place_b = np.arange(len(b)) + np.searchsorted(found.group_a, found.group_b, "right")
        ids, group, second = (np.empty(len(a) + len(b), np.int64) for _ in range(3))
        ids[place_a], group[place_a], second[place_a] = a, found.group_a, 0
        ids[place_b], group[place_b], second[place_b] = b, found.group_b, 1
        mark = np.zeros(len(ids), np.int64)
        mark[:-1] = np.where(group[1:] != group[:-1], 2, second[1:] != second[:-1])
        words = self.listed[mark * self.most + ids].tolist()
        digests, at = [], 0
        for size in sizes.tolist():
            listed = b"".join(words[at : at + size])[:-1]
            digests.append(hashlib.sha256(listed).hexdigest() if size else "")
            at += size
        return digests


_COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def aligned_rows(
    docs: DataFrame, key: str, text: str, tokenizer: str, ranks: str | None, model: str
) -> DataFrame:
    """Written: ``row`` (a number of its own), ``id``, the counts and the digest of each text,
    and ``pairs`` and ``often``, the pairs of ids it links and how often."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), text_of(F.col(text)).alias("text")
    )
    names = [part.split()[0] for part in _COUNTS.split(", ")] + ["pairs", "often"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _Texts(tokenizer, ranks, model)
        for batch in batches:
            for part in slices(batch, "text"):
                found = align(part.column("text").to_pylist())
                columns = [pa.array(found[name], kind) for name, kind in zip(names, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("id"), *columns], names=["row", "id", *names]
                )

    return stored(rows.mapInArrow(run, f"row bigint, id {kind}, {_COUNTS}, pairs binary, often binary"), "aligned")


def _width(binary: int) -> str:
    return "<u4" if binary <= 1 << 32 else "<u8"


def pair_counts(rows: DataFrame, space: int) -> DataFrame:
    """Written: ``pair`` and ``count``, how many links of the corpus hold the pair of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for part in parts(batch, 1024):
                more = np.frombuffer(b"".join(part.column("pairs").to_pylist()), _width(space)).astype(np.int64)
                often = np.frombuffer(b"".join(part.column("often").to_pylist()), "<u4").astype(np.int64)
                pairs, at = np.unique(np.concatenate([pairs, more]), return_inverse=True)
                # Sums stay exact: far fewer than 2 ** 53 links pass through one task.
                counts = np.bincount(at, np.concatenate([counts, often]), len(pairs)).astype(np.int64)
                if len(pairs) >= _GATHERED:
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "count"])
                    pairs, counts = pairs[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "count"])

    some = rows.select("pairs", "often").mapInArrow(run, "pair bigint, count bigint")
    return stored(some.groupBy("pair").agg(F.sum("count").alias("count")), "pair-counts")


def _border(counts: DataFrame, frequent: int) -> int:
    """The least power of two that at most ``frequent`` pairs reach."""
    level = F.floor(F.log2("count")).cast("int")
    sizes = {r.level: r.n for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    found, number = 62, 0
    while found and number + sizes.get(found - 1, 0) <= frequent:
        found -= 1
        number += sizes.get(found, 0)
    return 1 << found


def alignments(
    docs: DataFrame,
    tokenizer: str,
    model: str,
    ranks: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    frequent: int = FREQUENT,
) -> DataFrame:
    """One row per document: ``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum``, ``groups_sha256``.

    A are the ids of a space and the text by ``tokenizer`` (``ranks`` is its rank file), B
    those of the text by ``model``, which adds that space. A group is a longest run of bytes
    inside which no A and B token end at the same place; a link is an A and a B token that
    overlap. The count of a link is the number of links of the corpus with its two ids;
    ``n_best`` are the links whose count is the highest of their B id, ties included.
    ``frequent`` bounds what is broadcast and changes no result.

    Edges: null and empty texts, and those that either row of tokens does not give back byte
    for byte, have no tokens: zeros and an empty digest. Rows that share a key are counted
    one by one, a null key is kept, and an empty table gives no rows.
    """
    size_a, size_b = ByteEncoder(tokenizer, ranks).size, PieceEncoder(model).size
    space = size_a * size_b
    rows = aligned_rows(docs, key, text, tokenizer, ranks, model)
    counts = pair_counts(rows, space)
    border = _border(counts, frequent)
    # One row for each id of the vocabulary at most.
    heads = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("count").alias("most")).toArrow()
    most = np.zeros(size_b, np.int64)
    most[heads["b"].to_numpy()] = heads["most"].to_numpy()
    known = counts.where(F.col("count") >= border).toArrow()
    order = np.argsort(known["pair"].to_numpy())
    table = (
        known["pair"].to_numpy()[order].astype(_width(space)), known["count"].to_numpy()[order], most,
    )
    lookup = docs.sparkSession.sparkContext.broadcast(table)
    names = ("n_best", "count_sum", "rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, numbers, best = lookup.value
        for batch in batches:
            for part in parts(batch, 1024):
                listed = part.column("pairs").to_pylist()
                sizes = np.array([len(x) // pairs.itemsize for x in listed], np.int64)
                own = np.frombuffer(b"".join(listed), pairs.dtype)
                often = np.frombuffer(b"".join(part.column("often").to_pylist()), "<u4").astype(np.int64)
                row = np.repeat(np.arange(len(sizes)), sizes)
                at = np.searchsorted(pairs, own)
                there = at < len(pairs)
                there[there] = pairs[at[there]] == own[there]
                number, often_there, row_there = numbers[at[there]], often[there], row[there]
                top = number == best[own[there].astype(np.int64) % size_b]
                sums = np.zeros(len(sizes), np.int64)
                np.add.at(sums, row_there, number * often_there)
                tops = np.zeros(len(sizes), np.int64)
                np.add.at(tops, row_there[top], often_there[top])
                left = ~there
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[left], minlength=len(sizes)))])
                struct = pa.StructArray.from_arrays(
                    [pa.array(own[left].astype(np.int64)), pa.array(often[left])], names=["pair", "often"]
                )
                rest = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), struct)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(tops), pa.array(sums), rest], names=["row", *names]
                )

    schema = "row bigint, n_best bigint, count_sum bigint, rest array<struct<pair:bigint,often:bigint>>"
    near = stored(rows.select("row", "pairs", "often").mapInArrow(run, schema), "frequent-links")
    rare = counts.where(F.col("count") < border)
    heads_of = docs.sparkSession.createDataFrame(heads.rename_columns(["_b", "_most"]))
    # At most one row for each id of the vocabulary.
    rare = rare.join(F.broadcast(heads_of), F.col("pair") % size_b == F.col("_b")).select(
        F.col("pair").alias("_pair"), "count", (F.col("count") == F.col("_most")).alias("top")
    )
    rare = stored(rare, "rare-pairs")
    links = near.select("row", F.explode("rest").alias("link")).select("row", "link.*")
    far = links.join(rare, F.col("pair") == F.col("_pair")).groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.when(F.col("top"), F.col("often")).otherwise(0)).alias("_best"),
        F.sum(F.col("often") * F.col("count")).alias("_sum"),
    )
    far = stored(far, "rare-links")
    sums = near.join(far, F.col("row") == F.col("_row"), "left").select(
        F.col("row").alias("_of"),
        (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"),
    )
    return rows.join(sums, F.col("row") == F.col("_of")).select(
        F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
