"""Read JSON that a model wrote: fenced, wrapped in text, or cut off."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Cut-off texts of no more characters than this are not repaired.
LEAST = 20
_FENCE = re.compile(r"\A```(?:json)?\s*|\s*```\Z")
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"?|[{}\[\],:]|[^\s{}\[\],:"]+', re.S)
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_SCALAR = re.compile(r"true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_OPEN = re.compile(r'"(?:[^"\\]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*')
_CLOSER = {"{": "}", "[": "]"}


def loads(text: str | None) -> Any | None:
    """The parsed value, or None if nothing in the text can be read."""
    raw = _FENCE.sub("", (text or "").strip()) if (text or "").lstrip().startswith("```") else (text or "").strip()
    tried = None
    for candidate in (lambda: raw, lambda: raw[raw.index("{") : raw.rindex("}") + 1], lambda: closed(raw)):
        try:
            if (text := candidate()) != tried:
                tried = text
                return json.loads(text)
        except ValueError:  # no JSON, or no bracket
            continue
    return None


def closed(raw: str) -> str:
    """The longest beginning of an object that can be completed, with what it leaves open closed in the order of nesting.

    One pass with a stack of open brackets; each complete value, and each open
    string that stands for one, moves the place where the text may end. Unlike
    counting brackets this keeps the rows of a table that was cut inside one.
    """
    if not raw.startswith("{") or len(raw) <= LEAST:
        raise ValueError("no cut-off object")
    closers = ""  # what closes the open brackets, the innermost first
    wants = "value"  # value, key, colon or more: what may come next
    end, tail = 0, ""  # where the text may end, and what completes it there

    for m in _TOKEN.finditer(raw):
        token = m[0]
        if token in _CLOSER and wants == "value":
            closers = _CLOSER[token] + closers
            wants = "key" if token == "{" else "value"
            end, tail = m.end(), closers
        elif closers and token == closers[0] and wants != "colon" and not (token == "}" and wants == "value"):
            closers = closers[1:]
            wants = "more"
            end, tail = m.end(), closers
            if not closers:
                break
        elif token == "," and wants == "more":
            wants = "key" if closers[0] == "}" else "value"
        elif token == ":" and wants == "colon":
            wants = "value"
        elif token[0] == '"' and wants in ("key", "value"):
            # Only the last string can be open, at the end or before a last backslash.
            whole = m.end() < len(raw) - 1 or _STRING.fullmatch(token) is not None
            if wants == "key":
                if not whole:
                    break
                wants = "colon"
            elif whole:
                wants = "more"
                end, tail = m.end(), closers
            else:
                end, tail = _OPEN.match(raw, m.start()).end(), '"' + closers
                break
        elif wants == "value" and (scalar := _SCALAR.match(token)):
            wants = "more"
            end, tail = m.start() + scalar.end(), closers
            if scalar.end() < len(token):
                break
        else:
            break
    return raw[:end] + tail


def sheet(value: Any) -> dict:
    """A sheet with every part present and lists where lists belong."""
    value = dict(value) if isinstance(value, dict) else {}
    for key, default in (("title", None), ("tables", []), ("notes", []), ("complete", False)):
        value.setdefault(key, default)
    for key in ("tables", "notes"):
        if not isinstance(value[key], list):
            value[key] = []
    return value


@F.pandas_udf(StringType())
def repaired(texts: pd.Series) -> pd.Series:
    """Valid JSON of each text, null if it cannot be read. For rows that from_json rejects."""

    def one(text: str | None) -> str | None:
        value = loads(text) if text else None
        return None if value is None else json.dumps(value, ensure_ascii=False)

    return texts.map(one)

