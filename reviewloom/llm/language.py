"""Languages of texts by string kernels: Nyström landmarks and kernel ridge regression.

The kernel of two texts is a blended spectrum: for every order from 1 to ``ORDERS``, the share
of character n-grams that both hold, by presence, scaled so that a text with itself has 1;
the orders add up. N-grams are runs of letters of one word with its borders, hashed into
``2 ** bits`` places an order. A bounded set of landmark texts spans the space the regression
works in (Nyström); its normal equations are sums over labelled rows, added up in tasks, and
each language is one column of them (one versus the rest).

A text meets the landmarks only through inner products of presence rows, so the weights of
the landmarks fold into one weight for each n-gram and language. A batch of texts is scored by
the product of its presence rows and these weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import parts, slices, text_of
from reviewloom.operators.durable import stored

ORDERS = 4
UNKNOWN = "und"
_BORDER = 32
_TIMES = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    bits: int = 14  # places for n-grams of one order, as a power of two
    landmarks: int = 256
    max_labelled: int = 8_192  # the bound of the sample of labelled rows
    ridge: float = 1e-3  # the penalty, as a share of the number of labelled rows
    rank: float = 1e-6  # directions of the landmarks below this share of the largest are left out


def letters(text: str) -> np.ndarray:
    """Code points in lower case; every run of other characters is one border."""
    low = text.lower()
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    if low.isascii():
        fine = (codes >= 97) & (codes <= 122)
    else:
        # Each distinct character is looked at once.
        known, at = np.unique(codes, return_inverse=True)
        fine = np.array([chr(c).isalpha() for c in known.tolist()], bool)[at]
    codes = np.where(fine, codes, _BORDER)
    keep = np.ones(len(codes), bool)
    keep[1:] = fine[1:] | fine[:-1]
    return codes[keep]


def presence(text: str, bits: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The places of the n-grams a text holds, each once and ascending, and how many there
    are of each order. Null without a letter."""
    codes = letters(text)
    if not (codes != _BORDER).any():
        return None
    codes = np.concatenate([[_BORDER], codes, [_BORDER]]).astype(np.uint64)
    held = np.zeros(ORDERS << bits, bool)
    mixed = np.zeros(len(codes), np.uint64)
    for order in range(ORDERS):
        mixed = (mixed[: len(codes) - order] + codes[order:] + np.uint64(1)) * _TIMES
        mixed ^= mixed >> np.uint64(29)
        held[(order << bits) + (mixed * _TIMES >> np.uint64(64 - bits)).astype(np.int64)] = True
        if len(codes) <= order + 1:
            break
    sizes = np.count_nonzero(held.reshape(ORDERS, -1), axis=1)
    return np.flatnonzero(held), sizes


def _scales(sizes: np.ndarray) -> np.ndarray:
    return 1 / np.sqrt(np.maximum(sizes, 1) * ORDERS)


def _row(places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The weight of each present n-gram: presence, scaled by order."""
    return np.repeat(_scales(sizes), sizes).astype(np.float32)


def kernel(rows: list[tuple[np.ndarray, np.ndarray]], columns: np.ndarray) -> np.ndarray:
    """Presence rows times a matrix of one row per n-gram, as one matrix product of the
    n-grams that the batch holds."""
    held, at = np.unique(np.concatenate([places for places, _ in rows]), return_inverse=True)
    dense = np.zeros((len(rows), len(held)), np.float32)
    row = np.repeat(np.arange(len(rows)), [len(places) for places, _ in rows])
    dense[row, at] = np.concatenate([_row(*x) for x in rows])
    return dense @ columns[held].astype(np.float32)


@dataclass
class Model:
    """Languages, and their weight for every n-gram (one column each, float32)."""

    languages: list[str]
    weights: np.ndarray
    bits: int

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float]]:
        found = [presence(text, self.bits) for text in texts]
        known = [n for n, x in enumerate(found) if x is not None and self.languages]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known:
            margins = kernel([found[n] for n in known], self.weights).astype(np.float64)
            best = margins.argmax(axis=1)
            for n, k, row in zip(known, best.tolist(), margins, strict=True):
                names[n] = self.languages[k]
                # Margins aim at 1 for the language of a text and -1 for the rest.
                scores[n] = float(np.clip((row[k] + 1) / 2, 0, 1))
        return names, scores


def _sample(docs: DataFrame, key: str, text: str, lang: str, s: Settings) -> DataFrame:
    """Written: ``lang``, ``turn`` and ``text`` of labelled rows, about as many of each language."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(lang).alias("lang"),
        F.xxhash64(F.col(text)).alias("turn"),
        F.col(text).alias("text"),
    ).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # Copies of a text teach once; only their hashes are shuffled.
    distinct = rows.groupBy("lang", "turn").agg(F.min("row").alias("row"))
    distinct = stored(distinct, "labelled")
    sizes = distinct.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.lit(s.max_labelled) / F.greatest(F.lit(1), F.count("*").over(_everything()))
    sizes = stored(sizes.select(F.col("lang").alias("_lang"), (share / F.col("n")).alias("rate")), "languages")
    # The first by their hash, so that reruns agree.
    drawn = distinct.join(F.broadcast(sizes), F.col("lang") == F.col("_lang"))
    drawn = drawn.where(F.pmod(F.xxhash64("turn", F.lit(1)), F.lit(1 << 20)) < F.col("rate") * F.lit(1 << 20))
    drawn = drawn.orderBy(F.xxhash64("turn"), "lang").limit(s.max_labelled).select(F.col("row").alias("_row"))
    # The sample is bounded by max_labelled, so it may be broadcast.
    chosen = rows.join(F.broadcast(drawn), F.col("row") == F.col("_row"))
    return stored(chosen.select("lang", "turn", "text"), "sample")


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def fit(docs: DataFrame, key: str, text: str, lang: str, settings: Settings) -> Model:
    """Weights from at most ``max_labelled`` labelled rows of distinct texts."""
    s = settings
    sample = _sample(docs, key, text, lang, s)
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((ORDERS << s.bits, 0), np.float32), s.bits)
    context = docs.sparkSession.sparkContext
    bits = s.bits

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                held = []
                for value in part.column("text").to_pylist():
                    row = np.zeros(ORDERS << bits, bool)
                    row[presence(value, bits)[0]] = True
                    held.append(np.packbits(row).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["held"])

    # A landmark is a fixed number of bits, however long its text.
    first = sample.orderBy(F.xxhash64("turn", F.lit(2)), "lang").limit(s.landmarks)
    packed = first.mapInArrow(marks, "held binary").toArrow()["held"].to_pylist()
    held = np.stack([np.unpackbits(np.frombuffer(x, np.uint8)) for x in packed], axis=1)
    sizes = held.reshape(ORDERS, -1, held.shape[1]).sum(axis=1)
    scales = np.repeat(_scales(sizes), 1 << bits, axis=0).astype(np.float32)
    own = held * scales
    values, axes = np.linalg.eigh((own.T @ own).astype(np.float64))
    keep = values > s.rank * values[-1]
    # Kernel values times these are coordinates in the space of the landmarks.
    turn = axes[:, keep] / np.sqrt(values[keep])
    shared = context.broadcast((held.astype(bool), _scales(sizes).astype(np.float32), turn, languages))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, scale, turn, names = shared.value
        number = {name: n for n, name in enumerate(names)}
        width = turn.shape[1]
        gram, right = np.zeros((width, width)), np.zeros((width, len(names)))
        rows = 0
        for batch in batches:
            for part in slices(batch, "text", 64):
                found = [presence(x, bits) for x in part.column("text").to_pylist()]
                values = np.zeros((len(found), held.shape[1]))
                for n, (places, sizes) in enumerate(found):
                    own = _row(places, sizes)
                    cuts = np.concatenate([[0], np.cumsum(sizes)])
                    for order in range(ORDERS):
                        some = slice(cuts[order], cuts[order + 1])
                        values[n] += (own[some] @ held[places[some]]) * scale[order]
                spread = values @ turn
                aims = np.full((len(found), len(names)), -1.0)
                aims[np.arange(len(found)), [number[x] for x in part.column("lang").to_pylist()]] = 1
                gram += spread.T @ spread
                right += spread.T @ aims
                rows += len(found)
        listed = [gram.ravel().tolist(), right.ravel().tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows], pa.int64()), *[pa.array([x], pa.list_(pa.float64())) for x in listed]],
            names=["rows", "gram", "right"],
        )

    # One row a task, of a size that only the landmarks and languages set.
    parts_of = sample.select("lang", "text").mapInArrow(sums, "rows bigint, gram array<double>, right array<double>")
    width = turn.shape[1]
    gram, right, rows = np.zeros(width * width), np.zeros(width * len(languages)), 0
    for row in stored(parts_of, "normal-equations").toLocalIterator():
        gram, right, rows = gram + np.array(row.gram), right + np.array(row.right), rows + row.rows
    gram = gram.reshape(width, width) + s.ridge * max(rows, 1) * np.eye(width)
    duals = turn @ np.linalg.solve(gram, right.reshape(width, -1))
    return Model(languages, (own @ duals.astype(np.float32)).astype(np.float32), bits)


def languages(
    docs: DataFrame,
    known: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    settings: Settings | None = None,
) -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` (0 to 1) of every document, learned from ``known``.

    Only ``text`` and ``lang`` of ``known`` are learned from, and only ``text`` of ``docs`` is
    looked at. Edges: null texts and texts without a letter are ``und`` with score 0, as is
    everything where ``known`` has no language; rows that share a key are judged one by one;
    equal margins take the first language by name; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(known, key, text, lang, settings or Settings()))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), text_of(F.col(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model.value
        for batch in batches:
            for part in slices(batch, "text", 64, 1 << 18):
                names, scores = judge(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=["id", "lang_pred", "score"],
                )

    found = rows.mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return found.withColumnRenamed("id", key)


def held_out(key: Column, folds: int = 3, left: int = 1) -> Column:
    """Rows never to learn from: the crc32 of their key as text leaves ``left``. A null key
    is not held out."""
    found = F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)) == left
    return F.coalesce(found, F.lit(False))
