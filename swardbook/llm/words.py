"""Shared text conventions: what a word is, and native expressions over words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
JVM_SPACES = "[ \\x09-\\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
def word_array(text: Column) -> Column:
    """array<string> of the words of a text; empty for a null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), JVM_SPACES), "")


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def py_words(text: str | None) -> list[str]:
    """The same words in Python. str.split() would also cut at Unicode spaces."""
    if not text:
        return []
    for c in SPACES[1:]:
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]
