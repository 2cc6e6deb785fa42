"""Chat formatting: any layout of prompts, instructions or messages becomes marked turns.

The nested field paths of a table (or, where a table mixes layouts, of a row) are hashed, and
the hash selects a declarative mapping to canonical turns. Everything is a DataFrame
expression. The template is ``<turn>role</role>text</turn>`` and a line end for each turn;
where a role or text holds one of these marks or a backslash, a backslash is put into it, so
marks never appear inside and the texts can be read back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, MIDDLE, CLOSE = "<turn>", "</role>", "</turn>\n"
ASSISTANT = "assistant"
_ESCAPED = r"\\|(?<=<)(?=/?(?:turn|role)>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The nested paths to all leaves, like ``messages[].role``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}".strip("."))]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def _turn(role: Column, text: Column, place: Column | None = None) -> Column:
    place = F.lit(None) if place is None else place
    return F.struct(place.cast("bigint").alias("place"), role.alias("role"), text.alias("text"))


_SAID_BY = {"human": "user", "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}


def _role(name: Column) -> Column:
    found = name
    for said, role in _SAID_BY.items():
        found = F.when(F.lower(name) == said, role).otherwise(found)
    return found


def _fixed(*turns: tuple[str, str]) -> Callable[[], Column]:
    return lambda: F.array(*[_turn(F.lit(role), F.col(name).cast("string")) for role, name in turns])


def _listed(column: str, role: str, text: str) -> Callable[[], Column]:
    return lambda: F.transform(column, lambda m: _turn(_role(m[role]), m[text].cast("string")))


def _task() -> Column:
    asked = F.concat_ws("\n\n", F.col("instruction"), F.nullif(F.col("input"), F.lit("")))
    return F.array(_turn(F.lit("user"), asked), _turn(F.lit(ASSISTANT), F.col("output")))


@dataclass(frozen=True)
class Layout:
    paths: tuple[str, ...]
    turns: Callable[[], Column]


LAYOUTS = (
    Layout(("role", "text", "turn"), lambda: F.array(_turn(F.col("role"), F.col("text"), F.col("turn")))),
    Layout(("messages[].content", "messages[].role"), _listed("messages", "role", "content")),
    Layout(("conversations[].from", "conversations[].value"), _listed("conversations", "from", "value")),
    Layout(("prompt", "response"), _fixed(("user", "prompt"), (ASSISTANT, "response"))),
    Layout(("completion", "prompt"), _fixed(("user", "prompt"), (ASSISTANT, "completion"))),
    Layout(("answer", "question"), _fixed(("user", "question"), (ASSISTANT, "answer"))),
    Layout(("instruction", "output"), _fixed(("user", "instruction"), (ASSISTANT, "output"))),
    Layout(("input", "instruction", "output"), _task),
)
_KNOWN = sorted({path for layout in LAYOUTS for path in layout.paths})


def _root(path: str) -> str:
    return path.split("[")[0].split(".")[0]


def _present(paths: list[str]) -> Column:
    """The known paths that a row fills, in order."""
    return F.array_compact(F.array(*[F.when(F.col(_root(path)).isNotNull(), path) for path in paths]))


def fingerprint(paths: list[str]) -> Column:
    """The hash of the field paths that a row fills."""
    return F.xxhash64(F.array_join(_present(paths), ","))


def chosen_layout(present: set[str], fitting: list[Layout]) -> Layout | None:
    """The mapping of a set of filled paths, among the layouts whose paths a table has.

    The only layout there is (lists have to be filled), else the largest one that is filled,
    else the one with most filled paths (of equal ones the smaller, then the first); none
    where nothing is filled.
    """
    if len(fitting) == 1 and not all("[]" in path for path in fitting[0].paths):
        return fitting[0]
    ranked = []
    for at, layout in enumerate(fitting):
        number = len(present & set(layout.paths))
        ranked.append((number == len(layout.paths), number, -len(layout.paths), -at))
    best = max(range(len(fitting)), key=ranked.__getitem__)
    return fitting[best] if ranked[best][1] else None


def mappings(records: DataFrame) -> dict[int, tuple[list[str], Layout | None]]:
    """The fingerprints that occur, with their paths and the layout each selects.

    One row for each set of filled known paths, whatever the number of rows.
    """
    there = sorted(set(field_paths(records.schema)) & set(_KNOWN))
    fitting = [layout for layout in LAYOUTS if set(layout.paths) <= set(there)]
    if not fitting:
        raise ValueError(f"no layout for the paths {field_paths(records.schema)}")
    seen = records.select(fingerprint(there).alias("mark"), _present(there).alias("paths")).distinct()
    return {r.mark: (r.paths, chosen_layout(set(r.paths), fitting)) for r in seen.collect()}


def with_turns(records: DataFrame) -> DataFrame:
    """Add ``turns``, an array of place, role and text, by the mapping of the fingerprint.

    The fingerprint of a row is the hash of the field paths it fills, and looks its layout up
    in the table of those that occur (:func:`mappings`). Other columns, known to some layout or
    to none, are extra and stay as they are; only a column ``turns`` is replaced. A table with
    the paths of one layout has that one throughout, nulls included. In a table with the paths
    of several, a row takes the one that :func:`chosen_layout` finds, and its nulls read as
    empty. A row with nothing in any column that a layout knows has null turns; one that fits
    no layout but has something there is an error. A table without any is refused.
    """
    there = sorted(set(field_paths(records.schema)) & set(_KNOWN))
    known = mappings(records)
    lost = sorted(paths for paths, layout in known.values() if paths and layout is None)
    if lost:
        raise ValueError(f"no layout for a row with {', '.join(lost[0])}")
    used = [layout for layout in LAYOUTS if any(layout is own for _, own in known.values())]
    entries = [F.lit(x) for mark, (_, own) in known.items() if own for x in (mark, used.index(own))]
    if not entries:
        return records.withColumn("turns", F.lit(None).cast("array<struct<place:bigint,role:string,text:string>>"))
    number = F.element_at(F.create_map(*entries), fingerprint(there))
    turns = F.when(number == 0, used[0].turns())
    for at, layout in enumerate(used[1:], 1):
        turns = turns.when(number == at, layout.turns())
    return records.withColumn("turns", turns)


def formatted_chats(records: DataFrame, key: str) -> DataFrame:
    """One row per key: ``formatted`` and ``loss``, the spans the model learns from.

    Records of one key are one conversation; its turns go by their place (their place in the
    record where there is none), then by role and text. ``loss`` has start and end (code
    points of ``formatted``, end exclusive) of every assistant text, still escaped.

    A conversation is one value in the result, so its turns meet in one task; lengths are
    added up in a window over the same shuffle. Edges: null roles and texts read as empty;
    a null key is a conversation of its own; repeated rows are repeated turns; a record
    without anything in a layout or without turns adds none; an empty table gives no rows.
    """
    exploded = with_turns(records).select(
        F.col(key).alias("id"), F.posexplode("turns").alias("at", "turn")
    )
    role = F.coalesce(F.col("turn.role"), F.lit(""))
    text = F.coalesce(F.col("turn.text"), F.lit(""))
    rows = exploded.select(
        "id",
        F.coalesce("turn.place", F.col("at").cast("bigint")).alias("place"),
        role.alias("role"),
        F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE)).alias("head"),
        escape(text).alias("body"),
    )
    order = Window.partitionBy("id").orderBy("place", "role", "body")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + F.lit(len(CLOSE))
    placed = rows.withColumn("number", F.row_number().over(order)).withColumn(
        "start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")
    )
    turn = F.struct(
        "number",
        F.concat("head", "body", F.lit(CLOSE)).alias("marked"),
        F.when(
            F.col("role") == ASSISTANT,
            F.struct(F.col("start"), (F.col("start") + F.length("body")).alias("end")),
        ).alias("loss"),
    )
    gathered = placed.groupBy("id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return gathered.select(
        F.col("id").alias(key),
        F.array_join("turns.marked", "").alias("formatted"),
        F.array_compact(F.col("turns.loss")).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, unescaped, as an array of role and text."""
    parts = F.split(formatted, CLOSE)
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda part: F.struct(
            unescape(F.substring_index(F.substr(part, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"),
            unescape(
                F.substr(part, F.length(F.substring_index(part, MIDDLE, 1)) + F.lit(len(MIDDLE) + 1))
            ).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(
        loss,
        lambda span: unescape(
            F.substr(formatted, (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int"))
        ),
    )
