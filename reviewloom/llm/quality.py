"""Quality rules: ordered decision lists, learned by sequential covering.

Statistics of whole texts are computed once and written. From a bounded sample of labelled
rows the learner grows one conjunction of thresholds after another for the bad texts, prunes
each on rows it was not grown on, and drops the rows it covers. The list is applied as one
Spark conditional expression over the written statistics, and can be read as such.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import by_batch, text_of
from reviewloom.operators.durable import stored

SYMBOLS = b"#*$%&|<>"
_OTHER = bytes(sorted(set(range(256)) - set(SYMBOLS)))
_TAIL = bytes(range(0x80, 0xC0))  # bytes that go on a code point
_SPACE = b" \t\n\x0b\x0c\r"
_CAPITAL = re.compile(rb"[A-Z]+")
_MARKS = bytes(sorted(set(range(256)) - set(b"!?")))
_DIGITS = bytes(sorted(set(range(256)) - set(b"0123456789")))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_capitals", "n_marks", "n_digits")


def _repeated(words: list[bytes]) -> int:
    """Words in three-word windows that occur at least twice."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # Windows get their numbers in two steps, so that no code exceeds 64 bits.
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    code = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(code, kind="stable")
    equal = code[order][1:] == code[order][:-1]
    if not equal.any():
        return 0
    often = np.zeros(len(code), bool)
    often[order[1:][equal]] = True
    often[order[:-1][equal]] = True
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(code)] |= often
    return int(covered.sum())


def text_counts(text: str) -> tuple[int, ...]:
    """The counts named by ``COUNTS`` and ``MORE``, over the whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip(_SPACE)]
    chars = len(raw.translate(None, _TAIL + _SPACE))
    return (
        len(words),
        chars,
        len(raw.translate(None, _OTHER)),
        sum(n - 1 for n in Counter(lines).values()),
        _repeated(words),
        len(lines),
        sum(map(len, _CAPITAL.findall(raw))),
        len(raw.translate(None, _MARKS)),
        len(raw.translate(None, _DIGITS)),
    )


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the counts of every text; a null text has none of anything."""
    kind = docs.schema[key].dataType.simpleString()
    names = COUNTS + MORE
    rows = docs.select(F.col(key).cast("string").alias("id"), text_of(F.col(text)).alias("text"))

    def function(batch: dict[str, list]) -> dict[str, list]:
        found = list(zip(*map(text_counts, batch["text"]), strict=True))
        return {"id": batch["id"]} | dict(zip(names, found, strict=True))

    found = by_batch(rows, function, "id string, " + ", ".join(f"{n} bigint" for n in names))
    return found.select(F.col("id").cast(kind).alias(key), *names)


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0)).cast("double")


def features() -> dict[str, Column]:
    """What the rules speak of: figures that do not move with the length of a text.

    The share of distinct words does, and would make rules against long clean texts.
    """
    return {
        "chars_per_word": _share("word_chars", "n_words"),
        "symbols_per_word": _share("n_symbols", "n_words"),
        "marks_per_word": _share("n_marks", "n_words"),
        "repeated_words": _share("n_repeat_words", "n_words"),
        "repeated_lines": _share("n_dup_lines", "n_lines"),
        "capitals": _share("n_capitals", "word_chars"),
        "digits": _share("n_digits", "word_chars"),
        "words_per_line": _share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        values = table[self.feature]
        return values > self.threshold if self.above else values <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    size = len(next(iter(table.values())))
    return np.logical_and.reduce([np.ones(size, bool), *[c.holds(table) for c in rule]])


def _best(table: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> Condition | None:
    """The condition with the largest information gain for the bad rows inside."""
    p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
    base = math.log2(p0 / (p0 + n0))
    best, chosen = 1e-9, None
    for name, values in table.items():
        own, own_bad = values[inside], bad[inside]
        order = np.argsort(own, kind="stable")
        own, hits = own[order], np.cumsum(own_bad[order])
        border = np.flatnonzero(own[1:] > own[:-1])
        if not len(border):
            continue
        size = border + 1
        for above in (False, True):
            p = p0 - hits[border] if above else hits[border]
            n = (len(own) - size if above else size) - p
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0)
            at = int(np.argmax(gain))
            if gain[at] > best:
                best = float(gain[at])
                middle = (own[border[at]] + own[border[at] + 1]) / 2
                chosen = Condition(name, above, float(middle))
    return chosen


def learn(
    table: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, least: int = 3, longest: int = 4
) -> list[Rule]:
    """Ordered conjunctions for the bad rows; rows are in an order that has no meaning.

    Two thirds of the rows grow a rule, the others prune it: conditions go from the end
    while (p - n) / (p + n) does not fall. Learning ends with a rule under ``precision``.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    growing = np.arange(len(bad)) % 3 != 2
    while (bad & left & growing).sum() >= least:
        rule: Rule = ()
        inside = left & growing
        while len(rule) < longest and (~bad & inside).any():
            condition = _best(table, bad, inside)
            if condition is None:
                break
            rule += (condition,)
            inside = inside & condition.holds(table)
        if not rule:
            break

        def worth(some: Rule, rows: np.ndarray) -> float:
            hit = covers(some, table) & rows
            return (2 * (bad & hit).sum() - hit.sum()) / max(1, hit.sum())

        pruning = left & ~growing
        while len(rule) > 1 and worth(rule[:-1], pruning) >= worth(rule, pruning):
            rule = rule[:-1]
        hit = covers(rule, table) & left
        if hit.sum() < least or (bad & hit).sum() < precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def expression(rules: list[Rule]) -> Column:
    """The list as one conditional: the number of the first rule that holds, else 0."""
    columns, found = features(), None
    for number, rule in enumerate(rules, 1):
        tests = [
            columns[c.feature] > F.lit(c.threshold) if c.above else columns[c.feature] <= F.lit(c.threshold)
            for c in rule
        ]
        test = tests[0]
        for other in tests[1:]:
            test = test & other
        found = F.when(test, number) if found is None else found.when(test, number)
    return F.lit(0) if found is None else found.otherwise(0)


def fit(counts: DataFrame, labels: DataFrame, key: str, label: str, max_labelled: int) -> list[Rule]:
    """Rules from at most ``max_labelled`` labelled rows, the first by hash of their key."""
    known = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("good")).dropna()
    known = known.groupBy("_id").agg(F.min("good").alias("good"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    rows = counts.join(F.broadcast(chosen), counts[key] == F.col("_id")).select(
        "good", F.xxhash64("_id").alias("turn"), *[c.alias(n) for n, c in features().items()]
    )
    # At most max_labelled rows, but for keys that documents share.
    table = rows.limit(2 * max_labelled).toArrow().sort_by("turn")
    values = {name: table[name].to_numpy() for name in features()}
    return learn(values, table["good"].to_numpy() == 0)


def judged(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_labelled: int = 20_000,
    min_words: int = 50,
    most_repeated: int = 50,
) -> DataFrame:
    """``key``, the counts, ``base_failed``, ``rule`` (0: none holds) and ``kept``.

    Edges: a null or empty text fails the base rule; without labels no rule is learned and
    only the base rule speaks; a key labelled twice counts as bad if one label says so; rows
    that share a key are judged each; an empty table gives no rows.
    """
    counts = stored(statistics(docs, key, text), "statistics")
    rules = fit(counts, labels, key, label, max_labelled)
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")
    )
    rule = expression(rules).cast("int")
    return counts.select(
        key, *COUNTS, failed.alias("base_failed"), (~failed & (rule == 0)).alias("kept"), rule.alias("rule")
    )
