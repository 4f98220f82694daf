"""Bills of a whole month in one go, the bill editor's view, the chat snapshot."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import commit, invoice, linkage, merge, state, views
from .once import once

#: Default wording of a bill; a ledger's owner sets its own.
CLOSING = "Thank you for your business."
SIGNOFF = "With regards,"


def generate_month(clients: DataFrame, work: DataFrame, bills: DataFrame, jobs: DataFrame, month: str) -> dict[str, DataFrame]:
    """Re-target, rebuild from stored sheets, reprice, compile, and upsert bills: {clients, work, bills, rows, conflicts}.

    While conflicts has rows the rebuild changes nothing. Without stored sheets
    the lines stay as they are. The month's moves and lines are read several times
    and are checkpointed. Two looks, at whether there are moves and stored sheets,
    run at once and keep the steps that are not needed out of the plan.
    """
    moves = once(linkage.retarget_month(work, clients, month))
    if not moves.isEmpty():
        work, bills = state.reassign(work, bills, moves)
        clients = state.delete_ids(clients, linkage.orphans(clients, work, moves))
    conflicts = None
    stored = jobs.filter((F.col("status") == "stored") & (F.col("month") == month) & F.col("extract_json").isNotNull())
    if not stored.isEmpty():  # one look at the month's jobs decides whether there is anything to rebuild
        built = commit.rebuild_month(jobs, clients, work, month)
        clients, work, conflicts = built["clients"], built["work"], built["conflicts"]
    priced = clients.select(F.col("id").alias("__c"), "mow_price", "hedge_price")
    mine = work.filter(F.col("month") == month).join(priced, F.col("client_id") == F.col("__c")).drop("__c")
    lines = once(invoice.reprice_visits(mine))
    after = work.filter(F.col("month") != month).unionByName(lines.select(*work.columns))
    names = clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"))
    shown = lines.select("month", "client_id").distinct().join(names, "client_id").join(views.latest_bills(bills).select("month", "client_id", "display_name"), ["month", "client_id"], "left")
    shown = shown.withColumn("shown", F.coalesce(T.blank_to_null(F.col("display_name")), F.col("client_name")))
    made = shown.select("month", "client_id", bill_key(F.col("month"), F.col("client_id"), F.col("shown")).alias("s3_key"))
    return {"clients": clients, "work": after, "bills": state.upsert_bills(bills, made), "rows": invoice.compile_rows(lines), "conflicts": conflicts if conflicts is not None else lines.limit(0).select(F.lit(None).cast("string").alias("key"))}


def save_bills(clients: DataFrame, work: DataFrame, bills: DataFrame, edits: DataFrame, lines: DataFrame) -> dict[str, DataFrame]:
    """Save edited bills, any number in one go: {clients, work, bills}.

    edits, one row a bill: month, client_id, email, phone, address, delivery,
    intro, greeting, closing, signoff, to_client (also change the roster). lines:
    month, client_id, line_no and what editor_items reads. A bill's stored lines
    go, its new ones get the next ids and are repriced, its key is renewed and
    it counts as unsent; texts equal to the usual ones and faces equal to the
    roster's are stored as null. Edits of unknown clients are left out.
    """
    known = views.with_channel(clients).select(F.col("id").alias("__c"), F.col("name").alias("__name"), F.trim(F.coalesce("email", F.lit(""))).alias("__email"), F.col("channel").alias("__channel"))
    e = edits.join(known, F.col("client_id") == F.col("__c"))
    choice = F.lower(T.strip(F.col("delivery")))
    e = e.withColumns({"__choice": F.when(choice.isin(*T.CHANNELS), choice).otherwise(F.col("__channel")), **{c: T.strip(F.col(c)) for c in ("email", "phone", "address")}})
    contact = e.filter("to_client").select(F.col("client_id").alias("id"), "email", "address", "phone", F.col("__choice").alias("delivery"), (F.col("__choice") == "mail").alias("prefer_mail"))
    after = state.update_contact(clients, contact.dropDuplicates(["id"]))

    key = ["month", "client_id"]
    mine = e.select(F.col("month").alias("__m"), F.col("client_id").alias("__k"))
    of = (F.col("month") == F.col("__m")) & (F.col("client_id") == F.col("__k"))
    kept = work.join(mine, of, "left_anti")
    shown = lines.join(mine, of, "left_semi").withColumn("line_id", F.struct(*key, "line_no"))
    items = invoice.editor_items(shown).select("line_id.client_id", "line_id.line_no", "month", "piece", "description", F.col("amount").cast("decimal(12,2)").alias("amount"), "day_or_note")
    fresh = state.next_ids(work, items, ["client_id", "month", "line_no", "piece"]).drop("line_no", "piece")
    prices = after.select(F.col("id").alias("__c"), "mow_price", "hedge_price")
    typed = work.limit(0).unionByName(fresh, allowMissingColumns=True).join(prices, F.col("client_id") == F.col("__c")).drop("__c")
    new = invoice.reprice_visits(typed).select(*work.columns)

    faces = views.latest_bills(bills).select("month", "client_id", T.blank_to_null(F.col("display_name")).alias("__shown"))
    e = e.join(faces, key, "left").withColumn("__face", F.coalesce("__shown", "__name"))
    made = state.upsert_bills(bills, e.select(*key, bill_key(F.col("month"), F.col("client_id"), F.col("__face")).alias("s3_key")))
    ids = made.groupBy(*key).agg(F.max("id").alias("id"))
    e = e.join(ids, key)
    usual = {"cover_note": ("intro", T.invoice_sentence(F.col("month"), F.lit(None).cast("string"))), "greeting": ("greeting", F.concat(F.lit("Dear "), T.first_name(F.col("__face")), F.lit(","))), "closing": ("closing", F.lit(CLOSING)), "signoff": ("signoff", F.lit(SIGNOFF))}
    letters = e.select("id", *(T.stored_letter(F.col(given), default).alias(c) for c, (given, default) in usual.items()))
    own = lambda value, roster: F.when(~F.col("to_client") & (value != roster), value)
    face = e.select("id", F.col("__shown").alias("display_name"), own(F.col("email"), F.col("__email")).alias("bill_email"), own(F.col("__choice"), F.col("__channel")).alias("bill_delivery"))
    return {"clients": after, "work": kept.unionByName(new), "bills": state.set_faces(state.set_letters(made, letters), face)}


def bill_key(month: Column, client_id: Column, shown: Column) -> Column:
    """The object key of a bill."""
    return F.concat(F.lit("bills/"), month, F.lit("/"), client_id.cast("string"), F.lit("_"), F.substring(F.regexp_replace(shown, " ", "_"), 1, 40), F.lit(".pdf"))


def editable_bills(clients: DataFrame, bills: DataFrame, month: str) -> DataFrame:
    """What the editor shows above the lines, for every client: face, letter texts and roster values."""
    latest = views.latest_bills(bills.filter(F.col("month") == month)).select(F.col("id").alias("bill_id"), F.col("client_id").alias("__c"), "s3_key", "cover_note", "display_name", "bill_email", "bill_delivery", *(c for c in ("greeting", "closing", "signoff") if c in bills.columns))
    rows = views.with_channel(clients).join(latest, F.col("id") == F.col("__c"), "left")
    letter = lambda c: F.col(c) if c in latest.columns else F.lit(None).cast("string")
    choice = F.lower(T.strip(F.col("bill_delivery")))
    name = F.coalesce(T.blank_to_null(F.col("display_name")), F.col("name"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        F.lit(month).alias("month"), F.col("id").alias("client_id"), name.alias("client_name"), blank(F.coalesce("bill_email", "email")).alias("email"), blank("phone").alias("phone"), blank("address").alias("address"),
        F.when(choice.isin(*T.CHANNELS), choice).otherwise(F.col("channel")).alias("delivery"), "s3_key", "bill_id",
        T.letter_or_default(letter("greeting"), F.concat(F.lit("Dear "), T.first_name(name), F.lit(","))).alias("greeting"), T.invoice_sentence(F.lit(month), F.col("cover_note")).alias("intro"),
        T.letter_or_default(letter("closing"), F.lit(CLOSING)).alias("closing"), T.letter_or_default(letter("signoff"), F.lit(SIGNOFF)).alias("signoff"), blank("email").alias("roster_email"), F.col("channel").alias("roster_delivery"),
    )


#: Characters of a snapshot, rows to start from, and rows it never goes under.
ROOM, START, FLOOR = 10_000, {"work_items": 80, "bills": 40, "clients": 120}, {"work_items": 10, "bills": 0, "clients": 15}


def snapshot(clients: DataFrame, work: DataFrame, bills: DataFrame) -> str:
    """The newest rows as JSON, halved list by list (work, then bills, then clients) until it fits.

    What reaches the driver is bounded: START rows of each list and a count for each month.
    """
    on = clients.filter(F.coalesce("on_roster", F.lit(True)))
    people = views.roster(on).limit(START["clients"]).select("id", "name", *(F.coalesce(c, F.lit("")).alias(c) for c in ("email", "phone")), F.coalesce("prefer_mail", F.lit(False)).alias("prefer_mail"), F.coalesce("billing_notes", F.lit("")).alias("billing_notes"), *(F.col(c).cast("double").alias(c) for c in ("mow_price", "hedge_price")))
    jobs = views.snapshot_work(work, clients, START["work_items"]).select("id", "client_id", F.col("client_name").alias("client"), "month", "description", F.col("amount").cast("double").alias("amount"))
    sent = views.snapshot_bills(bills, clients, START["bills"]).select("id", "client_id", F.col("client_name").alias("client"), "month", "emailed")
    rows = {k: [r.asDict() for r in df.collect()] for k, df in (("clients", people), ("work_items", jobs), ("bills", sent))}
    total = on.count()
    months = {r["month"]: r["n"] for r in views.month_counts(work).collect()}
    while True:
        text = json.dumps({"client_count": total, "work_counts_by_month": months, "clients_truncated": len(rows["clients"]) < total, **rows}, ensure_ascii=False, default=str)
        long = next((k for k in ("work_items", "bills", "clients") if len(rows[k]) > FLOOR[k]), None)
        if len(text) <= ROOM or long is None:
            return text
        rows[long] = rows[long][: max(FLOOR[long], len(rows[long]) // 2)]


def leaks(clients: DataFrame, banned: tuple[str, ...] = merge.BANNED) -> DataFrame:
    """Clients whose notes hold a banned phrase, or whose locator line holds a dollar amount: none should."""
    notes = F.lower(F.coalesce("billing_notes", F.lit("")))
    phrase = F.lit(False)
    for b in banned:
        phrase = phrase | notes.contains(b)
    line = T.locator_line(*(F.col(c) for c in ("name", "address", "phone", "email", "prefer_mail", "billing_notes")))
    return clients.withColumns({"phrase": phrase, "priced": line.rlike(r"\$\s*\d")}).filter("phrase OR priced")
