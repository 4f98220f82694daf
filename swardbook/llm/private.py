"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text in a single scan: at-signs,
plus signs, digits, schemes and the cues of identifiers. At each anchor a local
parser expands to the boundaries of what it may belong to and validates that:
the local part and domain around an at-sign, the number after a plus, the groups
of an IP address and of a card number that begin at a digit, the user part of a
URL, the account number or secret after a cue. Parsers of a kind never go back
over what that kind has consumed, so a text costs its length, whatever it holds.

Kinds email, ip, card and phone are fixed by their patterns (leftmost, not
overlapping, a match that fails its check is consumed and dropped). The method
adds login (user and password in a URL), iban (two letters, digits and a valid
checksum) and secret (a long value with digits after a cue such as "token =").
Spans of different kinds may overlap; masking puts one mark on their union.

Defined cases: a null text is empty and has no span; a null doc_id stays null;
rows are read each for itself, so repeated rows and ids give equal rows; very
long texts are read whole; an empty table gives no rows; columns other than
doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans are listed; the first four are the base.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "secret")
SPANS = "array<struct<kind:string,start:int,end:int>>"

# Cues of secrets and of account numbers, in lower case.
CUES = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "private_key", "authorization: bearer")
ACCOUNT = "iban"

#: A secret value has at least this many characters.
SECRET = 16
#: Texts handed on at a time, and their characters.
ROWS, CHARS = 500, 4 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_GROUPS = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_DIAL = re.compile(r"\+[0-9][ ().0-9-]++")
_USER = re.compile(r"[^\s/?#@\"'<>:]++:[^\s/?#@\"'<>]++(?=@)")
_IBAN = re.compile(r"[\s:#]{0,3}+([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+)(?![A-Za-z0-9])")
_VALUE = re.compile(r"[\"']?\s{0,3}+[=:]?\s{0,3}+([\"']?)([A-Za-z0-9_+/=.-]++)\1")


def _automaton():
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, "digit")
    found.add_word("@", "at")
    found.add_word("+", "plus")
    found.add_word("://", "scheme")
    found.add_word(ACCOUNT, "account")
    for cue in CUES:
        found.add_word(cue, "cue")
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def valid_iban(account: str) -> bool:
    moved = account[4:] + account[:4]
    return 15 <= len(account) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


class Finder:
    """Anchors of a text and the parsers that expand them; one for each Python worker."""

    def __init__(self) -> None:
        self.automaton = _automaton()
        # Only A-Z, so that positions in the folded text are those of the text.
        self.fold = {c: c + 32 for c in range(65, 91)}

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by kind as listed, then start."""
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        done = dict.fromkeys(KINDS, 0)
        email_from = 0
        for at, anchor in self.automaton.iter(text.translate(self.fold)):
            if anchor == "digit":
                if at >= done["ip"]:
                    done["ip"] = self._address(text, at, found["ip"])
                if at >= done["card"]:
                    done["card"] = self._card(text, at, found["card"])
            elif anchor == "at":
                email_from = self._email(text, at, email_from, found["email"])
            elif anchor == "plus":
                self._phone(text, at, found["phone"])
            elif anchor == "scheme":
                if m := _USER.match(text, at + 1):
                    found["login"].append(m.span())
            elif anchor == "account" and at >= done["iban"]:
                done["iban"] = self._account(text, at, found["iban"])
            elif anchor == "cue" and at >= done["secret"]:
                done["secret"] = self._secret(text, at, found["secret"])
        return [(k, s, e) for k in KINDS for s, e in found[k]]

    def _email(self, text: str, at: int, floor: int, out: list) -> int:
        """Expand left over the local part and right over the domain; returns where the next local part may begin."""
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            return m.end()
        return max(floor, at + 1)

    def _address(self, text: str, at: int, out: list) -> int:
        """Four numbers at a time of a chain of numbers and dots."""
        m = _NUMBERS.match(text, at)
        parts = m[0].split(".")
        start = at
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(map(small, four)):
                out.append((start, end))
            start = end + 1
        return m.end()

    def _card(self, text: str, at: int, out: list) -> int:
        m = _GROUPS.match(text, at)
        if m.end() - at >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
        return m.end()

    def _phone(self, text: str, at: int, out: list) -> None:
        if m := _DIAL.match(text, at):
            end = m.end()
            while not ("0" <= text[end - 1] <= "9"):
                end -= 1
            # The pattern wants something between its first digit and its last.
            if end - at > 3 and 8 <= sum("0" <= c <= "9" for c in text[at:end]) <= 15:
                out.append((at, end))

    def _account(self, text: str, at: int, out: list) -> int:
        m = _IBAN.match(text, at + 1)
        if m and valid_iban(m[1].replace(" ", "")):
            out.append(m.span(1))
            return m.end()
        return at + 1

    def _secret(self, text: str, at: int, out: list) -> int:
        m = _VALUE.match(text, at + 1)
        if m and len(m[2]) >= SECRET and any(c.isdigit() for c in m[2]) and any(c.isalpha() for c in m[2]):
            out.append(m.span(2))
            return m.end()
        return at + 1


_finder: Finder | None = None


def finder() -> Finder:
    global _finder
    _finder = _finder or Finder()
    return _finder


_FIELDS = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _batch(ids: pa.Array, texts: pa.Array, lists: list[list[tuple[str, int, int]]]) -> pa.RecordBatch:
    ends = [0]
    for spans in lists:
        ends.append(ends[-1] + len(spans))
    flat = [x for spans in lists for x in spans]
    fields = [pa.array([x[i] for x in flat], type=_FIELDS.field(i).type) for i in range(3)]
    spans = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_FIELDS)))
    return pa.RecordBatch.from_arrays([ids, texts, spans], names=["doc_id", "text", "spans"])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    look = finder().spans
    for batch in batches:
        first, held, lists = 0, 0, []
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py() or ""
            lists.append(look(text))
            held += len(text)
            if len(lists) == ROWS or held > CHARS or i == batch.num_rows - 1:
                part = batch.slice(first, len(lists))
                yield _batch(part.column(0), part.column(1), lists)
                first, held, lists = i + 1, 0, []


def find(docs: DataFrame, texts: bool = False) -> DataFrame:
    """(doc_id, spans) for documents with doc_id and text, with texts also text; spans are (kind, start, end) in code points."""
    found = docs.select("doc_id", "text").mapInArrow(_find if texts else _bare, f"doc_id long, {'text string, ' if texts else ''}spans {SPANS}")
    return found


def _bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _find(batches):
        yield batch.select(["doc_id", "spans"])


def mask(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans) with each stretch of overlapping spans replaced by its first kind in angle brackets."""
    found = find(docs, texts=True)
    ordered = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("upto"))
    step = lambda acc, x: (
        F.when(x["start"] >= acc["upto"], F.struct(F.concat(acc["done"], F.substring(F.col("text"), acc["upto"] + 1, x["start"] - acc["upto"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")).alias("done"), x["end"].alias("upto")))
        .otherwise(F.struct(acc["done"].alias("done"), F.greatest(acc["upto"], x["end"]).alias("upto")))
    )
    masked = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["done"], F.substring(F.col("text"), acc["upto"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.size("spans") == 0, F.col("text")).otherwise(masked))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(of(*BASE)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
