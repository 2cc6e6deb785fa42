"""Toxicity scores: logistic regression by FTRL-proximal over hashed word n-grams.

Features are the single words (whole and as stems), word pairs, and pairs with one word
between them that a text holds, hashed into ``2 ** bits`` places. Labelled texts are cut into shards; every shard
learns on its own, the states of the shards are averaged, and the next round goes on from
there. The L1 term leaves few weights, which travel to the executors as one small array.
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import by_task, parts, text_of
from reviewloom.operators.durable import stored

# Punctuation does not belong to words here: "word," and "word" are one feature.
_PLAIN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_LOW = np.uint64(0xFFFFFFFF)
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CACHE = 50_000
# Inflected words share a stem: their first letters.
STEM = 5


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    max_labelled: int = 16_000  # the bound of the sample of labelled rows
    shard_rows: int = 4_000  # labelled rows that one task learns from, about
    rounds: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    prior: float = -1.0  # the constant before any label: toxic texts are the fewer ones


class _Hashes(dict):
    """Hashes of the words that a task has seen and, above 32 bits, of their stems.

    Emptied when it grows large.
    """

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        plain = word.decode("utf-8", "surrogatepass").lower()
        whole = zlib.crc32(plain.encode("utf-8", "surrogatepass"))
        stem = zlib.crc32(plain[:STEM].encode("utf-8", "surrogatepass"), 1)
        value = self[word] = stem << 32 | whole
        return value


def places(text: str, bits: int, hashes: dict[bytes, int] | None = None) -> np.ndarray:
    """The places of all features of a text, with repeats; place 0 is the constant.

    ``hashes`` keeps what is known of words; a task has its own, which goes with it.
    """
    known = _Hashes() if hashes is None else hashes
    words = text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()
    found = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    single, stems = (found & _LOW) + np.uint64(1), found >> np.uint64(32)
    pairs = single[:-1] * _PAIR + single[1:]
    skips = single[:-2] * _SKIP + (single[2:] ^ _PAIR)
    mixed = np.concatenate([single, stems ^ _SKIP, pairs, skips])
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _PAIR
    found = (mixed >> np.uint64(64 - bits)).astype(np.int64)
    return np.concatenate([[0], np.maximum(found, 1)])


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def weights_of(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """Weights of some places, the constant first: it is not shrunk by the L1 term."""
    shrunk = np.sign(z) * np.maximum(np.abs(z) - s.l1, 0)
    shrunk[0] = z[0]
    return -shrunk / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)


def learn(texts: list[np.ndarray], labels: np.ndarray, z: np.ndarray, n: np.ndarray, s: Settings) -> None:
    """One pass; the rates are per coordinate. Changes ``z`` and ``n``."""
    for at, label in zip(texts, labels, strict=True):
        w = weights_of(z[at], n[at], s)
        g = _sigmoid(w.sum()) - label
        grown = n[at] + g * g
        z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / s.alpha * w
        n[at] = grown


def _packed(frame: pd.DataFrame) -> pd.DataFrame:
    """A shard as one row, in the order of the hash: it is then read again, not shuffled."""
    frame = frame.sort_values("turn", kind="stable")
    texts = [np.asarray(x, np.int32) for x in frame["at"]]
    ends = np.cumsum([len(x) for x in texts]).astype(np.int64)
    at, y = np.concatenate(texts), frame["y"].to_numpy(np.int64)
    return pd.DataFrame({"at": [at.tobytes()], "ends": [ends.tobytes()], "y": [y.tobytes()]})


def _shard(state: Broadcast, s: Settings) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                z, n = (x.copy() for x in state.value)
                ends = np.frombuffer(row.ends, np.int64)
                texts = np.split(np.frombuffer(row.at, np.int32), ends[:-1])
                learn(texts, np.frombuffer(row.y, np.int64), z, n, s)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"at": at, "z": z[at], "n": n[at]})

    return run


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, s: Settings) -> np.ndarray:
    """Weights from at most ``max_labelled`` labelled rows, the first by hash of their key.

    Rows without a key or label teach nothing; a key labelled twice takes the larger label.
    """
    known = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("y")).dropna()
    known = known.groupBy("_id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(s.max_labelled)
    own = docs.select(F.col(key).alias("id"), text_of(F.col(text)).alias("text"))
    # The sample is bounded by max_labelled, so it may be broadcast.
    sample = own.join(F.broadcast(chosen), F.col("id") == F.col("_id")).select(
        F.xxhash64("id").alias("turn"), F.col("y").cast("bigint").alias("y"), "text"
    )

    def start() -> Callable[[dict[str, list]], dict[str, list]]:
        hashes = _Hashes()

        def featured(batch: dict[str, list]) -> dict[str, list]:
            found = [np.unique(places(x, s.bits, hashes)) for x in batch["text"]]
            return {"turn": batch["turn"], "y": batch["y"], "at": found}

        return featured

    rows = stored(by_task(sample, start, "turn bigint, y bigint, at array<int>"), "labelled")
    shards = max(1, math.ceil(rows.count() / s.shard_rows))
    rows = rows.withColumn("shard", F.pmod("turn", F.lit(shards))).groupBy("shard")
    rows = stored(rows.applyInPandas(_packed, "at binary, ends binary, y binary"), "shards")
    size = 1 << s.bits
    z, n = np.zeros(size, np.float64), np.zeros(size, np.float64)
    z[0] = -s.prior * (s.beta / s.alpha + s.l2)
    for _ in range(s.rounds):
        state = docs.sparkSession.sparkContext.broadcast((z, n))
        learned = rows.mapInPandas(_shard(state, s), "at bigint, z double, n double")
        # One row per place: bounded by the number of places, whatever the corpus.
        summed = learned.groupBy("at").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toArrow()
        if not summed.num_rows:
            break
        z, n = np.zeros(size), np.zeros(size)
        at = summed["at"].to_numpy()
        z[at], n[at] = summed["z"].to_numpy() / shards, summed["n"].to_numpy() / shards
    return weights_of(z, n, s).astype(np.float32)


def score_texts(
    texts: list[str], weights: np.ndarray, bits: int, hashes: dict[bytes, int] | None = None
) -> list[float]:
    scores, hashes = [], _Hashes() if hashes is None else hashes
    for text in texts:
        found = places(text, bits, hashes)
        # Most weights are zero: only the others need to be made distinct.
        found = np.unique(found[weights[found] != 0])
        scores.append(_sigmoid(float(weights[found].astype(np.float64).sum())))
    return scores


def scores(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    settings: Settings | None = None,
) -> DataFrame:
    """``key`` and ``score`` (0 to 1) of every document, learned from ``labels``.

    Edges: null and empty texts get the score of the constant; without any labelled row
    every score is that of the prior; rows that share a key are scored one by one; an empty table gives
    no rows.
    """
    s = settings or Settings()
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text, label, s))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("string").alias("id"), text_of(F.col(text)).alias("text"))

    def start() -> Callable[[dict[str, list]], dict[str, list]]:
        hashes = _Hashes()
        return lambda batch: {"id": batch["id"], "score": score_texts(batch["text"], weights.value, s.bits, hashes)}

    found = by_task(rows, start, "id string, score double")
    return found.select(F.col("id").cast(kind).alias(key), "score")


def held_out(key: Column, folds: int = 5) -> Column:
    """Rows never to learn from: the crc32 of their key as text leaves no remainder. A null
    key is not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def without_toxic(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: float = 0.5
) -> DataFrame:
    """The documents that score under ``most``, with all their columns."""
    settings = Settings()
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text, "toxic", settings))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for part in parts(batch):
                texts = [x or "" for x in part.column(text).to_pylist()]
                found = score_texts(texts, weights.value, settings.bits, hashes)
                yield part.filter(pa.array([score < most for score in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
