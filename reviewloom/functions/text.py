"""Text and list expressions. All of them stay on the JVM: no Python function per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions.fixed_values import (
    MISSING_TEXT,
    PUNCTUATION,
    RECIPE_COLUMNS,
)

# A word is a run of at least two letters, digits or underscores in any script.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def clean_text(text: Column) -> Column:
    """Lower-case the text and turn each punctuation mark into one blank."""
    return F.translate(F.lower(text), PUNCTUATION, " " * len(PUNCTUATION))


def split_on_blank(text: Column) -> Column:
    """Split at every single blank; empty tokens, tabs and line ends stay."""
    return F.split(text, " ")


def word_tokens(text: Column) -> Column:
    """All words (see ``WORD_PATTERN``) of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def counted(words: Column) -> Column:
    """The different words of a list as structs of ``word`` and its number ``n``, sorted."""

    def runs(ordered: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ordered) - 1)
        first = F.filter(places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return F.get(F.transform(F.array(first), lambda starts: entries(ordered, starts)), F.lit(0))

    def entries(ordered: Column, starts: Column) -> Column:
        def entry(start: Column, i: Column) -> Column:
            end = F.coalesce(F.get(starts, i + 1), F.size(ordered))
            return F.struct(F.get(ordered, start).alias("word"), (end - start).cast("bigint").alias("n"))

        return F.transform(starts, entry)

    # Arrays of one element make the lists lambda variables: sorted once per row.
    return F.get(F.transform(F.array(F.sort_array(words)), runs), F.lit(0))


def fill_missing_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(MISSING_TEXT))


def parse_number_list(printed: Column) -> Column:
    """``"[1, 2.0]"`` to ``[1.0, 2.0]``; an element that is no number becomes null."""
    parts = F.split(F.replace(_strip_brackets(printed), F.lit(","), F.lit("")), " ")
    return F.transform(parts, lambda part: part.try_cast("double"))


def parse_string_list(printed: Column, strict: bool = False) -> Column:
    """``"['a', 'b']"`` to ``["a", "b"]``.

    By default every ``'`` is deleted, also one inside a word. ``strict`` reads the text
    as a list of quoted strings and keeps apostrophes.
    """
    if strict:
        return F.from_json(printed, "array<string>")
    unquoted = F.replace(_strip_brackets(printed), F.lit("'"), F.lit(""))
    return F.split(unquoted, ", ")


def _strip_brackets(printed: Column) -> Column:
    return F.btrim(printed, F.lit("[]"))


def list_columns(values: Column, count: int, prefix: str) -> list[Column]:
    """The first ``count`` elements as columns ``prefix_0``, ``prefix_1`` and so on."""
    return [F.get(values, F.lit(i)).alias(f"{prefix}_{i}") for i in range(count)]


def word_runs(text: Column, max_len: int = 2, missing: str | None = None) -> Column:
    """All runs of 1 to ``max_len`` neighbouring words, by start position, then length.

    Repeated blanks count as one. Null gives an empty array, or the single word
    ``missing`` when that is given.
    """
    if max_len < 1:
        raise ValueError("max_len must be at least 1")

    def runs_from(words: Column, start: Column) -> Column:
        longest = F.least(F.lit(max_len), F.size(words) - start)
        return F.transform(
            F.sequence(F.lit(1), longest),
            lambda length: F.array_join(F.slice(words, start + 1, length), " "),
        )

    def runs_of(words: Column) -> Column:
        return F.flatten(F.transform(words, lambda _, start: runs_from(words, start)))

    # The one-element array makes the split words a lambda variable: split once per row,
    # not once per word.
    split_words = F.split(F.regexp_replace(text, " +", " "), " ")
    runs = F.get(F.transform(F.array(split_words), runs_of), F.lit(0))
    fallback = F.array() if missing is None else F.array(F.lit(missing))
    return F.coalesce(runs, fallback.cast("array<string>"))


def concat_lists(*lists: Column) -> Column:
    """The lists of a row one after the other; a null list counts as empty."""
    empty = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(one, empty) for one in lists])


def join_words(words: Column) -> Column:
    return F.array_join(words, " ")


def recipe_words(names: Sequence[str], compat: bool = False) -> Column:
    """The word list of a recipe from the chosen text columns, always in one fixed order.

    Printed lists (tags, ingredients, steps) are parsed, prose (name, description) gives
    runs of one and two words. With ``compat`` the columns steps and description are read
    from ``name`` and a missing prose text gives the word ``nan``.
    """
    unknown = set(names) - set(RECIPE_COLUMNS)
    if unknown or not names:
        raise ValueError(f"choose from {RECIPE_COLUMNS}, not {sorted(unknown)}")
    missing = "nan" if compat else None
    lists = []
    for name in RECIPE_COLUMNS:
        if name not in names:
            continue
        source = "name" if compat and name in ("steps", "description") else name
        if name in ("name", "description"):
            lists.append(word_runs(F.col(source), 2, missing))
        else:
            lists.append(parse_string_list(F.col(source)))
    return concat_lists(*lists)


def picture_words(tags_per_picture: Column, top: int = 10) -> Column:
    """The first ``top`` tags of every picture of a review, in one list."""
    return F.flatten(F.transform(tags_per_picture, lambda tags: F.slice(tags, 1, top)))


def append_picture_words(text: Column, words: Column) -> Column:
    """Review text, a blank, the picture words; unchanged where the words are null."""
    extended = F.concat(F.coalesce(text, F.lit("")), F.lit(" "), join_words(words))
    return F.when(words.isNull(), text).otherwise(extended)


def picture_link(picture_id: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), picture_id)
