"""Column helpers for text: trimming, lines, words and tokens, with ASCII rules on every engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What counts as blank around a line.
BLANKS = " \t\r\n\x0b\x0c ﻿"


def trim(col: Column | str) -> Column:
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS))


def split_lines(text: Column | str) -> Column:
    return F.split(F.col(text) if isinstance(text, str) else text, "\n")


def words_pattern(words: str) -> str:
    """Whole words, where letters, digits and underscore of ASCII make up a word (Java's \\b goes by Unicode)."""
    return rf"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"


# One boundary between a word character and another one, for patterns that put operators between boundaries.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def capture(text: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null when there is none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, group))


def capture_all(text: Column | str, pattern: str, group: int = 1) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def word_tokens(text: Column) -> Column:
    """Runs of ASCII word characters and single other symbols, blanks dropped."""
    return F.regexp_extract_all(text, F.lit(r"\w+|[^\s\w]"), F.lit(0))


def basename(path: Column | str) -> Column:
    return F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"([^/]*)$", 1)


def extension(path: Column | str) -> Column:
    """Lower-cased extension with its dot, empty when there is none (a leading dot makes no extension)."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))
