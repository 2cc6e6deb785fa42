"""Personal data in texts, also in disguise, at its place in the source.

Plain identifiers are found in the text as it is. Disguised ones are found in a second,
normalised reading: transducers rewrite look-alike letters, digits written as words, and
"at" and "dot" in their guises, and remember which source characters every rewritten piece
stands for. Identifiers of that reading that touch a rewritten piece are mapped back.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import by_batch, text_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """From every @ to the left over the local part, then to the right over the host.

    The same as the leftmost matches of the whole pattern, without trying every start.
    """
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            yield start, end
        at = text.find("@", at + 1)


def ips(text: str) -> Iterator[Span]:
    for found in _IP.finditer(text):
        parts = [part.lstrip("0") or "0" for part in found.group().split(".")]
        if all(len(part) <= 3 and int(part) <= 255 for part in parts):
            yield found.span()


def cards(text: str) -> Iterator[Span]:
    for found in _CARD.finditer(text):
        if found.end() - found.start() >= 14:
            digits = _NOT_DIGIT.sub("", found.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield found.span()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", found.group())) <= 15:
                yield found.span()


FINDERS: tuple[Callable[[str], Iterator[Span]], ...] = (emails, ips, cards, phones)

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοα",
        "ABESIJKMHOPCTYXaesijopcyxdqwh" + "ABEZHIKMNOPTYXoa",
        strict=True,
    )
)
# Full-width signs stand 0xFEE0 above the plain ones.
LOOKALIKES |= {chr(code + 0xFEE0): chr(code) for code in range(0x21, 0x7F)}
# Characters without width.
INVISIBLE = "​‌‍⁠﻿­"
# The digits from 0 to 9 as words, in English, German, French and Spanish.
_DIGITS_BY_LANGUAGE = (
    ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"),
    ("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"),
    ("zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"),
    ("cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"),
)
DIGIT_WORDS = {word: str(n) for words in _DIGITS_BY_LANGUAGE for n, word in enumerate(words)} | {"oh": "0"}
# Words for the signs of an address and for the plus sign, in these languages.
AT_WORDS = ("at", "arobase", "arobas", "arroba", "klammeraffe")
DOT_WORDS = ("dot", "punkt", "point", "punto")
PLUS_WORDS = ("plus", "más", "mas")

_ODD = re.compile("[" + re.escape("".join(LOOKALIKES) + INVISIBLE) + "]")
_ODD_RUN = re.compile("[" + re.escape("".join(LOOKALIKES) + INVISIBLE) + "]+")
_WORD_DIGIT = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
# At least three in a row, so that a lone number word stays a word.
_SPELLED = re.compile(rf"(?i)(?<![a-z0-9]){_WORD_DIGIT}(?:[\x20,.-]{{1,2}}(?:{_WORD_DIGIT}|[0-9]+)){{2,}}(?![a-z])")
_SPELLED_PART = re.compile(rf"(?i)({_WORD_DIGIT})|[0-9]+|[^a-z0-9]+")
_PLUS = re.compile(rf"(?i)(?<![a-z])(?:{'|'.join(PLUS_WORDS)})[\x20]+(?=[0-9]|{_WORD_DIGIT}[\x20,.-])")
_BLANK = r"[\x20\t]"


def _dot(opening: str, words: str, closing: str) -> str:
    bracketed = rf"{_BLANK}*{opening}+{_BLANK}*(?:{words}|\.){_BLANK}*{closing}+{_BLANK}*"
    return rf"(?:{bracketed}|{_BLANK}+(?:{words}){_BLANK}+|\.)"


_OPEN, _CLOSE = r"[(\[{<]", r"[)\]}>]"
_DOT = _dot(_OPEN, "|".join(DOT_WORDS), _CLOSE)
_DOT_RE = re.compile(rf"(?i){_DOT}")
_BLANKS = re.compile(rf"{_BLANK}*")
# An at sign without the blanks around it; a run of brackets is looked at from its start.
_AT_RE = re.compile(
    rf"(?i)(?<!{_OPEN}){_OPEN}+{_BLANK}*(?:{'|'.join(AT_WORDS)}|@){_BLANK}*{_CLOSE}+"
    rf"|(?<={_BLANK})(?:{'|'.join(AT_WORDS)})(?={_BLANK})|@"
)
_LABEL, _NAME = r"[A-Za-z0-9-]+", r"[A-Za-z0-9_%+-]+"
# What follows a sign, and, read from the sign to the left, what goes before it. No repeat has
# a bound: a name and a dot share no character, so a scan goes over each character once.
_WORDED_HOST = re.compile(rf"(?i){_LABEL}(?:{_DOT}{_LABEL})+")
_WORDED_LOCAL = re.compile(rf"(?i){_NAME}(?:{_dot(_CLOSE, '|'.join(word[::-1] for word in DOT_WORDS), _OPEN)}{_NAME})*")
_DOT_SIGN = re.compile(rf"(?i){_OPEN}{_BLANK}*(?:{'|'.join(DOT_WORDS)}|\.){_BLANK}*{_CLOSE}|{_BLANK}(?:{'|'.join(DOT_WORDS)}){_BLANK}|\.")
_DOT_IP = re.compile(rf"(?i)(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])")
# Domain endings that are no common words. The bare word "at" needs one of them.
ENDINGS = frozenset(
    "com org net edu gov mil info biz io dev app co uk de fr es nl eu ca au jp ch se pl pt br".split()
)
_ENDING = re.compile(r"(?i)[a-z]{2,24}\Z")


class Rewritten:
    """A text after some replacements, which maps its places back to the source."""

    def __init__(self, source: str, changes: list[tuple[int, int, str]]):
        parts, self.out, self.src, self.changed = [], [0], [0], []
        at = size = 0
        for start, end, new in changes:
            parts += [source[at:start], new]
            size += start - at
            self.out += [size, size + len(new)]
            self.src += [start, end]
            self.changed.append((size, size + len(new)))
            size += len(new)
            at = end
        parts.append(source[at:])
        self.text = "".join(parts)

    def back(self, place: int, end: bool = False) -> int:
        """The source place; inside a replacement, its start or its end."""
        at = bisect_right(self.out, place - 1 if end else place) - 1
        if at % 2:  # inside a replacement
            return self.src[at + 1] if end else self.src[at]
        return self.src[at] + place - self.out[at]

    def touches(self, start: int, end: int) -> bool:
        at = bisect_right(self.changed, (start, -1))
        near = self.changed[max(0, at - 1) : at + 1]
        return any(a < end and b > start or a == b and start < a < end for a, b in near)


def _letters(text: str) -> list[tuple[int, int, str]]:
    """Look-alikes and invisible characters, where they stand in words with Latin signs."""
    changes = []
    for found in _ODD_RUN.finditer(text):
        new = "".join(LOOKALIKES.get(c, "") for c in found.group())
        changes.append((found.start(), found.end(), new))
    return changes


def _numbers(text: str) -> list[tuple[int, int, str]]:
    changes = []
    for run in _SPELLED.finditer(text):
        for part in _SPELLED_PART.finditer(run.group()):
            word = part.group(1)
            if word or not part.group().isdigit():
                new = DIGIT_WORDS[word.lower()] if word else ""
                changes.append((run.start() + part.start(), run.start() + part.end(), new))
    changes += [(found.start(), found.end(), "+") for found in _PLUS.finditer(text)]
    return sorted(changes)


def _addresses(text: str) -> Iterator[tuple[tuple[int, int], list[tuple[int, int]]]]:
    """Of each disguised address the place of its at sign and the places of its dots."""
    backwards = last = None
    for found in _AT_RE.finditer(text):
        sign = found.group().lower()
        start, end = found.span()
        right = _BLANKS.match(text, end).end()
        host = _WORDED_HOST.match(text, right)
        if last is not None and start < last or not host:
            continue
        if backwards is None:
            backwards = text[::-1]
        left = len(text) - _BLANKS.match(backwards, len(text) - start).end()
        local = _WORDED_LOCAL.match(backwards, len(text) - left)
        if not local:
            continue
        begin = len(text) - local.end()
        dots = [(*dot.span(), dot.group()) for a, b in ((begin, left), host.span()) for dot in _DOT_RE.finditer(text, a, b)]
        worded = [dot for a, _, dot in dots if a >= right and dot != "."]
        bare = sign in AT_WORDS
        plain = sign == "@" and (left, right) == (start, end)
        # The word alone or a lone sign needs a dot in disguise behind it: "at noon. Then" has none.
        if not worded and (bare or sign == "@"):
            if not plain or all(dot == "." for *_, dot in dots):
                continue
        ending = _DOT_RE.split(host.group())[-1].lower()
        foreign = any(dot.strip().lower() in DOT_WORDS[1:] for dot in worded)
        if not _ENDING.search(ending) or (bare or foreign) and ending not in ENDINGS:
            continue
        last = host.end()
        yield (left, right), [(a, b) for a, b, dot in dots if dot != "."]


def _signs(text: str) -> list[tuple[int, int, str]]:
    changes = []
    if not _DOT_SIGN.search(text):
        return changes
    for at, dots in _addresses(text):
        changes += [(*dot, ".") for dot in dots]
        if text[at[0] : at[1]] != "@":
            changes.append((*at, "@"))
    for found in _DOT_IP.finditer(text):
        for dot in _DOT_RE.finditer(text, found.start(), found.end()):
            if dot.group() != ".":
                changes.append((*dot.span(), "."))
    return sorted(set(changes))


TRANSDUCERS = (_letters, _numbers, _signs)


def disguised(text: str) -> Iterator[tuple[int, int, str]]:
    """Identifiers that show only in the normalised reading, as source spans."""
    readings: list[Rewritten] = []
    current = text
    for transducer in TRANSDUCERS:
        changes = transducer(current)
        if changes:
            readings.append(Rewritten(current, changes))
            current = readings[-1].text
    if not readings:
        return
    for kind, finder in zip(KINDS, FINDERS, strict=True):
        for start, end in finder(current):
            seen = False
            for reading in reversed(readings):
                seen |= reading.touches(start, end)
                start, end = reading.back(start), reading.back(end, end=True)
            if seen and any(c.isalnum() for c in text[start:end]):
                yield start, end, kind


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Plain spans, and all spans: an added one overlaps no plain one of its kind."""
    base = [(a, b, kind) for kind, finder in zip(KINDS, FINDERS, strict=True) for a, b in finder(text)]
    base.sort(key=_place)
    added = [
        found
        for found in disguised(text)
        if not any(found[2] == kind and a < found[1] and b > found[0] for a, b, kind in base)
    ]
    return base, sorted(base + added, key=_place)


def _place(span: tuple[int, int, str]) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_<kind>`` of plain spans, ``base`` and ``spans`` as ``kind:start:end`` lists.

    Places count code points, the end is exclusive; spans go by start, then by kind. Edges:
    null and empty texts have no spans; rows that share a key are searched each; an empty
    table gives no rows.
    """
    kind_of = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("string").alias("id"), text_of(F.col(text)).alias("text"))

    def function(batch: dict[str, list]) -> dict[str, list]:
        found = [find(x) for x in batch["text"]]
        counts = {f"n_{k}": [sum(s[2] == k for s in base) for base, _ in found] for k in KINDS}
        lists = {"base": [listed(base) for base, _ in found], "spans": [listed(every) for _, every in found]}
        return {"id": batch["id"]} | counts | lists

    columns = [f"n_{k}" for k in KINDS]
    schema = "id string, " + ", ".join(f"{c} bigint" for c in columns) + ", base string, spans string"
    return by_batch(rows, function, schema).select(
        F.col("id").cast(kind_of).alias(key), *columns, "base", "spans"
    )
