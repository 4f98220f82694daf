"""Chat questions about months: which month, status or wipe, and the reply. Column expressions."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Month names as they are written, by number.
NAMES = (
    ("january", "jan"), ("february", "feb"), ("march", "mar"), ("april", "apr"), ("may",), ("june", "jun"), ("july", "jul"), ("august", "aug"),
    ("september", "sept", "sep"), ("october", "oct"), ("november", "nov"), ("december", "dec"),
)
_ANY = "|".join(sorted((n for names in NAMES for n in names), key=len, reverse=True))
_NAMED = rf"\b({_ANY})\b(?:\s+(20\d{{2}}))?"
_THIS = r"\b(?:this|current)\s+month\b"
#: Fixed patterns of the questions.
WIPE = r"\b(delete|remove|wipe|clear|erase|drop)\b"
SHOW = r"\b(show|list|display)\b"
ASK = r"\b(have|has|any|how many|count|what's in|whats in|what is in|left|stored|data|work|bills?|pdfs?|still)\b"


def month_of(text: Column, today: Column) -> Column:
    """The month a text names: 2026-09, a name (a later month is last year's), or this month; else null."""
    explicit = F.regexp_extract(text, r"\b(20\d{2}-\d{2})\b", 1)
    number = F.substring(explicit, 6, 2).try_cast("int")
    table = F.create_map(*(F.lit(x) for i, names in enumerate(NAMES, 1) for n in names for x in (n, i)))
    named = F.regexp_extract(text, _NAMED, 1)
    at = F.element_at(table, F.nullif(named, F.lit("")))
    year = F.coalesce(F.nullif(F.regexp_extract(text, _NAMED, 2), F.lit("")).try_cast("int"), F.when(at <= F.month(today), F.year(today)).otherwise(F.year(today) - 1))
    return (
        F.when(explicit != "", F.when(number.between(1, 12), explicit))
        .when(named != "", F.concat(year.cast("string"), F.lit("-"), F.lpad(at.cast("string"), 2, "0")))
        .when(text.rlike(_THIS), T.work_month(today))
    )


def status_month(question: Column, today: Column) -> Column:
    """The month whose contents are asked for."""
    text = F.lower(T.strip(question))
    return F.when(~text.rlike(WIPE) & ~text.rlike(SHOW) & text.rlike(ASK), month_of(text, today))


def wipe_month(question: Column, today: Column) -> Column:
    """The month to delete as a whole."""
    text = F.lower(T.strip(question))
    return F.when(text.rlike(WIPE), month_of(text, today))


def reply(month: Column, work: Column, bills: Column, test_work: Column, sheets: Column) -> Column:
    """What is stored, in words."""
    many = lambda n, one, more: F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(more))
    first = F.concat(month, F.lit(" has "), many(work, "stored work line", "stored work lines"), F.lit(" and "), many(bills, "generated bill", "generated bills"), F.lit("."))
    none = F.when((work == 0) & (bills == 0), F.concat(F.lit("That is not the test data. test_month (test data) has "), many(test_work, "work line", "work lines"), F.lit(".")))
    still = F.when(sheets > 0, F.concat(F.when(sheets == 1, "There is also ").otherwise("There are also "), many(sheets, "OCR sheet", "OCR sheets"), F.lit(" for "), month, F.lit(" still on the review/upload list (not the same as sent work).")))
    return F.concat_ws(" ", first, none, still)


class Mutations:
    """A chat turn's commands over clients, work and bills, in order.

    A turn holds a few commands, so the fold over them is on the driver; what
    each does, and what it logs, stays a lazy plan. A command that cannot be read
    or names nothing is logged and changes nothing, and the next one goes on.
    """

    def __init__(self, clients: DataFrame, work: DataFrame, bills: DataFrame) -> None:
        self.clients, self.work, self.bills = clients, work, bills
        self.lines: list[DataFrame] = []

    def say(self, line: Column | str, row: DataFrame | None = None) -> None:
        row = self.clients.sparkSession.range(1) if row is None else row
        text = line if isinstance(line, Column) else F.lit(line)
        self.lines.append(row.select(F.lit(len(self.lines)).alias("seq"), text.alias("line")))

    @property
    def log(self) -> DataFrame:
        """(seq, line)"""
        empty = self.clients.sparkSession.createDataFrame([], "seq int, line string")
        return reduce(DataFrame.union, self.lines, empty)

    def apply(self, commands: list | None) -> "Mutations":
        for c in commands or []:
            if not isinstance(c, dict):
                continue
            op = str(c.get("op") or "").strip().lower()
            step = getattr(self, f"_{op}", None) if op in OPERATIONS else None
            try:
                self.say(f"skipped unknown op {op!r}") if step is None else step(c)
            except (TypeError, ValueError) as e:
                self.say(f"failed {op}: {e}")
        return self

    def _who(self, c: dict) -> tuple[DataFrame, bool] | None:
        """(one row whose who is the client's id or null, whether an id was given), or None if the command names nobody."""
        try:
            given = int(c["client_id"]) if c.get("client_id") is not None else None
        except (TypeError, ValueError):
            given = None
        name = str(c.get("client_name") or c.get("name") or "").strip()
        if given == 0 or given is None and not name:
            return None
        mine = F.col("id") == given if given is not None else F.lower(F.trim("name")) == F.lower(F.trim(F.lit(name)))
        return self.clients.filter(mine).agg(F.min("id").alias("who")), given is not None

    def _row(self, row: DataFrame, **values) -> DataFrame:
        text = lambda v: F.lit(None if v is None else str(v)).cast("string")
        return row.select("*", *(text(v).alias(k) for k, v in values.items()))

    def _update_client(self, c: dict) -> None:
        from ..operators import state

        found = self._who(c)
        if found is None:
            return self.say("skipped update_client (unknown client)")
        who, by_id = found
        prices = {k: number(c.get(k)) for k in ("mow_price", "hedge_price")}
        change = self._row(who, **{k: c.get(k) for k in ("name", "email", "phone", "address", "billing_notes")}, **prices).filter("who IS NOT NULL").withColumnRenamed("who", "id")
        before = self.clients.select(F.col("id").alias("__b"), F.coalesce("name", F.lit("")).alias("__old"))
        self.clients = state.patch_clients(self.clients, change)
        now = self.clients.select(F.col("id").alias("__a"), *(F.coalesce(F.col(k).cast("string"), F.lit("None")).alias(f"__{k}") for k in ("email", "address", "mow_price", "hedge_price")))
        row = who.join(before, F.col("who") == F.col("__b"), "left").join(now, F.col("who") == F.col("__a"), "left")
        told = F.format_string("updated client #%s %s → email=%s, address=%s, mow=%s, hedge=%s", F.col("who").cast("string"), "__old", "__email", "__address", "__mow_price", "__hedge_price")
        none = "failed update_client: client not found" if by_id else "skipped update_client (unknown client)"
        self.say(F.when(F.col("who").isNull(), none).otherwise(told), row)

    def _update_work(self, c: dict) -> None:
        from ..operators import state

        if c.get("work_id") is None:
            return self.say("skipped update_work (no work_id)")
        at = int(c["work_id"])
        there = self.work.filter(F.col("id") == at).agg(F.min("id").alias("id"))
        change = self._row(there.filter("id IS NOT NULL"), description=c.get("description"), amount=number(c.get("amount")), month=c.get("month"))
        self.work = state.patch_work(self.work, change)
        self.say(F.when(F.col("id").isNull(), "failed update_work: work item not found").otherwise(f"updated work_item #{at}"), there)

    def _add_work(self, c: dict) -> None:
        from ..operators import state

        found, month = self._who(c), str(c.get("month") or "").strip()
        if found is None or not month:
            return self.say("skipped add_work (need client + month)")
        who, by_id = found
        try:
            amount = number(c.get("amount")) or None
        except ValueError:
            amount = None
        new = self._row(who.filter("who IS NOT NULL"), month=month, description=c.get("description") or "service", amount=amount).withColumnRenamed("who", "client_id")
        top = self.work.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("new"))
        told = F.format_string(f"added work_item #%s for client #%s ({month.replace('%', '%%')})", F.col("new").cast("string"), F.col("who").cast("string"))
        none = "failed add_work: client not found" if by_id else "skipped add_work (need client + month)"
        self.say(F.when(F.col("who").isNull(), none).otherwise(told), who.crossJoin(top))  # one row each
        self.work = state.insert_work(self.work, new.withColumn("amount", F.col("amount").cast("decimal(12,2)")), ["client_id"])

    def _delete_work(self, c: dict) -> None:
        if c.get("work_id") is None:
            return self.say("skipped delete_work (no work_id)")
        self.work = self.work.filter(F.col("id") != int(c["work_id"]))
        self.say(f"deleted work_item #{c['work_id']}")

    def _delete_work_month(self, c: dict) -> None:
        from ..operators import state

        month = str(c.get("month") or "").strip()
        if not re.fullmatch(r"20\d{2}-\d{2}", month):
            return self.say("skipped delete_work_month (month must be YYYY-MM)")
        count = lambda df, name: df.filter(F.col("month") == month).agg(F.count("*").cast("string").alias(name))
        row = count(self.work, "lines").crossJoin(count(self.bills, "bills"))  # one row each
        self.say(F.format_string(f"deleted %s work lines and %s bills for {month}", "lines", "bills"), row)
        self.work, self.bills, _ = state.delete_month(self.work, self.bills, month)


#: Commands that a chat turn may hold.
OPERATIONS = ("update_client", "update_work", "add_work", "delete_work", "delete_work_month")


#: Amounts are stored as decimal(12,2).
LARGEST = Decimal(10) ** 10


def number(value) -> str | None:
    """An amount as text: null for none, blank to clear it; anything that is no number, or none that can be stored, is an error."""
    if value is None or str(value).strip() == "":
        return None if value is None else ""
    exact = Decimal(str(float(value)))
    if not exact.is_finite() or abs(exact) >= LARGEST:
        raise ValueError(f"amount out of range: {value}")
    stored = exact.quantize(Decimal("0.01"), ROUND_HALF_UP)
    if abs(stored) >= LARGEST:
        raise ValueError(f"amount out of range: {value}")
    return str(stored)
