"""State changes as pure transforms: each takes relations and returns new ones.

Three merge rules look alike and differ: coalesce_* keeps the old value for a
null, save_* overwrites with null, patch_* keeps for null and clears for blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from .numbering import id_block, numbered, prefix

CONTACT = ("email", "phone", "address", "billing_address", "billing_notes", "mow_price", "hedge_price", "hedge_roster", "prefer_mail", "on_roster", "entity_kind", "sort_order", "mowing_group")
NEW_CLIENT = {"hedge_roster": False, "prefer_mail": False, "on_roster": True, "entity_kind": "client"}


def _key(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def next_ids(df: DataFrame, new: DataFrame, order: list[str], column: str = "id") -> DataFrame:
    """Give new rows ids after the largest one, in order: by a prefix of a first text column, by blocks of a first number."""
    first = F.col(order[0])
    text = isinstance(new.schema[order[0]].dataType, StringType)
    top = df.agg(F.coalesce(F.max(column), F.lit(0)).alias("__top"))
    rows = numbered(new, "__rank", order, [prefix(first, 8) if text else id_block(first)])
    return rows.crossJoin(F.broadcast(top)).withColumn(column, (F.col("__top") + F.col("__rank")).cast("long")).drop("__rank", "__top")  # top is one row


def _matched(clients: DataFrame, changes: DataFrame) -> DataFrame:
    return clients.alias("c").join(changes.alias("n"), F.lower(F.trim(F.col("c.name"))) == F.lower(F.trim(F.col("n.name"))), "full_outer")


def coalesce_clients(clients: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert by trimmed lower-case name: null keeps the old value; new names get defaults and the next ids."""
    fields = [c for c in CONTACT if c in clients.columns]
    given = lambda c: F.col(f"n.{c}") if c in changes.columns else F.lit(None)
    old = lambda c: F.coalesce(F.col(f"c.{c}"), F.when(F.col("c.id").isNull(), F.lit(NEW_CLIENT.get(c))))
    merged = _matched(clients, changes).select(
        F.col("c.id").alias("id"), F.coalesce("c.name", F.trim("n.name")).alias("name"), *(F.coalesce(given(c), old(c)).alias(c) for c in fields), *(F.col(f"c.{c}").alias(c) for c in clients.columns if c not in ("id", "name", *fields))
    ).select(*clients.columns)
    fresh = next_ids(clients, merged.filter("id IS NULL").drop("id"), ["name"]).select(*clients.columns)
    return merged.filter("id IS NOT NULL").unionByName(fresh)


def check_typed(clients: DataFrame, changes: DataFrame) -> DataFrame:
    """Reasons why typed rows cannot be saved: (id, name, reason)."""
    ids = clients.select(F.col("id").alias("__id"))
    names = clients.select(F.col("id").alias("__owner"), _key("name").alias("__key"))
    unknown = changes.filter("id IS NOT NULL").join(ids, F.col("id") == F.col("__id"), "left_anti").select("id", "name", F.lit("was not found").alias("reason"))
    clash = changes.filter("id IS NOT NULL").join(names, (_key("name") == F.col("__key")) & (F.col("id") != F.col("__owner"))).select("id", "name", F.lit("is already on file").alias("reason"))
    blank = changes.filter(T.strip(F.col("name")) == "").select("id", "name", F.lit("name required").alias("reason"))
    return unknown.union(clash).union(blank)


def save_clients(clients: DataFrame, changes: DataFrame) -> DataFrame:
    """Typed rows by id: every field is overwritten, null clears. hedge_roster follows the hedge price, delivery the mail box."""
    typed = ("name", "address", "phone", "email", "billing_notes", "mow_price", "hedge_price", "prefer_mail", "on_roster")
    rows = clients.alias("c").join(changes.alias("n"), F.col("c.id") == F.col("n.id"), "left")
    hit = F.col("n.id").isNotNull()
    new = {
        **{c: F.col(f"n.{c}") for c in typed if c in changes.columns},
        "hedge_roster": F.col("n.hedge_price").isNotNull(),
        "delivery": mail_choice(F.col("c.delivery"), F.col("n.prefer_mail")),
    }
    return rows.select(*(F.when(hit, new[c]).otherwise(F.col(f"c.{c}")).alias(c) if c in new else F.col(f"c.{c}") for c in clients.columns))


def mail_choice(delivery: Column, prefer_mail: Column) -> Column:
    """The mail box forces paper; clearing it leaves an email or SMS choice."""
    return F.when(F.coalesce(prefer_mail, F.lit(False)), "mail").when(delivery == "mail", F.lit(None)).otherwise(delivery)


def office_clients(clients: DataFrame, changes: DataFrame) -> DataFrame:
    """Fields the office list owns: notes and hedge data are overwritten, null clears; the name only if given."""
    rows = clients.alias("c").join(changes.alias("n"), F.col("c.id") == F.col("n.id"), "left")
    hit = F.col("n.id").isNotNull()
    new = {"name": F.coalesce("n.name", "c.name"), "billing_notes": F.col("n.billing_notes"), "hedge_price": F.col("n.hedge_price"), "hedge_roster": F.coalesce("n.hedge_roster", F.lit(False))}
    return rows.select(*(F.when(hit, new[c]).otherwise(F.col(f"c.{c}")).alias(c) if c in new else F.col(f"c.{c}") for c in clients.columns))


def patched(new: Column, old: Column) -> Column:
    """Null keeps, blank clears, anything else is stripped and set."""
    return F.when(new.isNull(), old).otherwise(F.nullif(T.strip(new), F.lit("")))


def patch_rows(df: DataFrame, changes: DataFrame, texts: tuple[str, ...], numbers: tuple[str, ...] = ()) -> DataFrame:
    """Patch rows by id with text changes; numbers come as text too, so that blank can clear them."""
    rows = df.alias("c").join(changes.alias("n"), F.col("c.id") == F.col("n.id"), "left")
    out = []
    for c in df.columns:
        old = F.col(f"c.{c}")
        if c in texts and c in changes.columns:
            old = patched(F.col(f"n.{c}"), old)
        elif c in numbers and c in changes.columns:
            given = F.col(f"n.{c}")
            old = F.when(given.isNull(), old).otherwise(T.blank_to_null(given).try_cast("decimal(12,2)"))
        out.append(old.alias(c))
    return rows.select(*out)


def patch_clients(clients: DataFrame, changes: DataFrame) -> DataFrame:
    return patch_rows(clients, changes, ("name", "email", "phone", "address", "billing_notes"), ("mow_price", "hedge_price"))


def patch_work(work: DataFrame, changes: DataFrame) -> DataFrame:
    """Patch lines by id: null keeps; a description is set as it is, a month stripped, a blank amount clears."""
    rows = patch_rows(work, changes, (), ("amount",))
    texts = [c for c in ("description", "month") if c in changes.columns]
    given = changes.select(F.col("id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in texts))
    new = {"description": F.col("__description") if "description" in texts else None, "month": T.strip(F.col("__month")) if "month" in texts else None}
    rows = rows.join(given, F.col("id") == F.col("__id"), "left")
    return rows.select(*(F.when(F.col(f"__{c}").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in texts else c for c in work.columns))


def _overwrite(df: DataFrame, changes: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Set columns by id to what the changes hold, null included."""
    rows = df.alias("c").join(changes.alias("n"), F.col("c.id") == F.col("n.id"), "left")
    hit = F.col("n.id").isNotNull()
    return rows.select(*(F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"c.{c}")).alias(c) if c in columns and c in changes.columns else F.col(f"c.{c}").alias(c) for c in df.columns))


def update_work(work: DataFrame, changes: DataFrame) -> DataFrame:
    """Set description and amount by id, null included; the note too if the changes have it at all."""
    return _overwrite(work, changes, ("description", "amount", "day_or_note"))


def update_contact(clients: DataFrame, changes: DataFrame) -> DataFrame:
    """Set email, address, phone and delivery by id, blank as null; paper mail as given, else no; the name only if there is one."""
    texts = ("email", "address", "phone", "delivery")
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c) if c in changes.columns else F.lit(None).cast("string").alias(c)
    mail = F.coalesce("prefer_mail", F.lit(False)) if "prefer_mail" in changes.columns else F.lit(False)
    name = F.col("name") if "name" in changes.columns else F.lit(None).cast("string")
    new = changes.select("id", *(blank(c) for c in texts), mail.alias("prefer_mail"), name.alias("__name"))
    rows = _overwrite(clients, new, (*texts, "prefer_mail"))
    names = new.filter("__name IS NOT NULL").select(F.col("id").alias("__id"), "__name")
    return rows.join(names, F.col("id") == F.col("__id"), "left").withColumn("name", F.coalesce("__name", "name")).select(*clients.columns)


def set_emails(clients: DataFrame, changes: DataFrame) -> DataFrame:
    """Set the email alone by id, blank as null."""
    return _overwrite(clients, changes.select("id", F.nullif(F.col("email"), F.lit("")).alias("email")), ("email",))


def insert_bills(bills: DataFrame, made: DataFrame) -> DataFrame:
    """Append bills (month, client_id, s3_key) with the next ids, whatever there is already."""
    return bills.unionByName(next_ids(bills, made, ["month", "client_id"]), allowMissingColumns=True)


def set_faces(bills: DataFrame, faces: DataFrame) -> DataFrame:
    """Set display_name, bill_email and bill_delivery of bills by id, null included."""
    return _overwrite(bills, faces, ("display_name", "bill_email", "bill_delivery"))


def set_letters(bills: DataFrame, letters: DataFrame) -> DataFrame:
    """Set the texts of bills by id: cover_note, greeting, closing, signoff as given, null included."""
    texts = ("cover_note", "greeting", "closing", "signoff")
    missing = {c: F.lit(None).cast("string") for c in texts if c not in bills.columns and c in letters.columns}
    return _overwrite(bills.withColumns(missing), letters, texts)


def insert_work(work: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Append lines with the next ids, in the given order."""
    return work.unionByName(next_ids(work, new, order), allowMissingColumns=True)


def delete_ids(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias("__id")).distinct(), F.col(column) == F.col("__id"), "left_anti")


def replace_job_lines(work: DataFrame, lines: DataFrame) -> DataFrame:
    """Drop what the same (month, job) sent before, then append: sending twice gives the same rows."""
    sent = lines.select(F.col("month").alias("__m"), F.col("source_job_id").alias("__j")).distinct()
    kept = work.join(sent, (F.col("month") == F.col("__m")) & (F.col("source_job_id") == F.col("__j")), "left_anti")
    return kept.unionByName(lines, allowMissingColumns=True)


def delete_sourced_month(work: DataFrame, month: str) -> DataFrame:
    """Lines of a sheet go, hand-typed ones stay."""
    return work.filter((F.col("month") != month) | F.col("source_job_id").isNull())


def delete_month(work: DataFrame, bills: DataFrame, month: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(work, bills, removed): removed has the object keys of the bills that went."""
    return work.filter(F.col("month") != month), bills.filter(F.col("month") != month), bills.filter(F.col("month") == month).select("s3_key")


def delete_client_month(work: DataFrame, bills: DataFrame, month: str, client_id: int) -> tuple[DataFrame, DataFrame]:
    mine = (F.col("month") == month) & (F.col("client_id") == client_id)
    return work.filter(~mine), bills.filter(~mine)


def delete_client(clients: DataFrame, work: DataFrame, bills: DataFrame, client_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A client goes with all lines and bills."""
    return clients.filter(F.col("id") != client_id), work.filter(F.col("client_id") != client_id), bills.filter(F.col("client_id") != client_id)


def reassign(work: DataFrame, bills: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move clients' months (month, source, target). A target's own bill stays and the source's goes; else it moves along."""
    m = moves.filter("source <> target").select(F.col("month").alias("__m"), F.col("source").alias("__s"), F.col("target").alias("__t"))
    moved = work.join(m, (F.col("month") == F.col("__m")) & (F.col("client_id") == F.col("__s")), "left")
    moved = moved.withColumn("client_id", F.coalesce("__t", "client_id")).select(*work.columns)
    owners = bills.select(F.col("month").alias("__om"), F.col("client_id").alias("__oc")).distinct()
    b = bills.join(m, (F.col("month") == F.col("__m")) & (F.col("client_id") == F.col("__s")), "left")
    b = b.join(owners, (F.col("month") == F.col("__om")) & (F.col("__t") == F.col("__oc")), "left")
    b = b.filter("__t IS NULL OR __oc IS NULL").withColumn("client_id", F.coalesce("__t", "client_id"))
    return moved, b.select(*bills.columns)


def upsert_bills(bills: DataFrame, made: DataFrame) -> DataFrame:
    """New keys for the newest bill of each (month, client), which is unsent again; others are inserted.

    made: month, client_id, s3_key.
    """
    newest = bills.groupBy("month", "client_id").agg(F.max("id").alias("__newest"))
    joined = made.alias("n").join(newest.alias("o"), ["month", "client_id"], "left")
    known = joined.filter("__newest IS NOT NULL").select(F.col("__newest").alias("__id"), F.col("s3_key").alias("__key"))
    rows = bills.join(known, F.col("id") == F.col("__id"), "left")
    rows = rows.withColumns({"s3_key": F.coalesce("__key", "s3_key"), "emailed_at": F.when(F.col("__id").isNull(), F.col("emailed_at"))}).select(*bills.columns)
    fresh = next_ids(bills, joined.filter("__newest IS NULL").drop("__newest"), ["month", "client_id"])
    return rows.unionByName(fresh, allowMissingColumns=True)


def set_bill_face(bills: DataFrame, faces: DataFrame) -> DataFrame:
    """Month-only name, email and delivery by bill id. A value equal to the roster's is stored as null: use the roster."""
    rows = bills.alias("b").join(faces.alias("f"), F.col("b.id") == F.col("f.id"), "left")
    own = {
        "display_name": T.blank_to_null(F.nullif(T.strip(F.col("f.name")), T.strip(F.col("f.roster_name")))),
        "bill_email": F.when(~F.col("f.email").eqNullSafe(F.col("f.roster_email")), F.col("f.email")),
        "bill_delivery": F.nullif(F.col("f.delivery"), F.col("f.roster_delivery")),
    }
    return rows.select(*(F.when(F.col("f.id").isNotNull(), own[c]).otherwise(F.col(f"b.{c}")).alias(c) if c in own else F.col(f"b.{c}") for c in bills.columns))


def mark_emailed(bills: DataFrame, sent: DataFrame) -> DataFrame:
    """Stamp the bills whose ids were sent."""
    ids = sent.select(F.col("id").alias("__id")).distinct()
    return bills.join(ids, F.col("id") == F.col("__id"), "left").withColumn("emailed_at", F.when(F.col("__id").isNotNull(), F.current_timestamp().cast("timestamp_ntz")).otherwise(F.col("emailed_at"))).drop("__id")


def upsert_jobs(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """By id: status and message are set; extract, prefix, month and kind keep their value for a null."""
    keep = ("extract_json", "s3_prefix", "month", "sheet_kind")
    rows = jobs.alias("o").join(changes.alias("n"), F.col("o.id") == F.col("n.id"), "full_outer")
    hit = F.col("n.id").isNotNull()

    def value(c: str) -> Column:
        old, new = F.col(f"o.{c}"), F.col(f"n.{c}") if c in changes.columns else F.lit(None)
        if c == "id":
            return F.coalesce("o.id", "n.id")
        if c in keep or c not in changes.columns:
            return F.coalesce(new, old)
        return F.when(hit, new).otherwise(old)

    return rows.select(*(value(c).alias(c) for c in jobs.columns))


def open_job() -> Column:
    return F.col("status").isin("done", "stored")


def save_drafts(jobs: DataFrame, drafts: DataFrame) -> DataFrame:
    """Edited sheets of open or sent jobs, by id; other jobs stay as they are."""
    d = drafts.select(F.col("id").alias("__id"), F.col("extract_json").alias("__x"), F.col("month").alias("__m"))
    rows = jobs.join(d, (F.col("id") == F.col("__id")) & open_job(), "left")
    return rows.withColumns({"extract_json": F.coalesce("__x", "extract_json"), "month": F.coalesce(T.blank_to_null(F.col("__m")), "month")}).select(*jobs.columns)


def clear_reviews(jobs: DataFrame, work: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open and sent reviews become cleared; the lines that a sent one stored go."""
    asked = ids.select(F.col("id").alias("__id")).distinct()
    stored = jobs.filter("status = 'stored'").join(asked, F.col("id") == F.col("__id"), "left_semi").select(F.col("id").alias("__j"), F.trim("month").alias("__m"))
    left = work.join(stored, (F.col("source_job_id") == F.col("__j")) & (F.col("month") == F.col("__m")), "left_anti")
    rows = jobs.join(asked, F.col("id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull() & open_job()
    rows = rows.withColumns({"progress_msg": F.when(hit, "Review cleared").otherwise(F.col("progress_msg")), "status": F.when(hit, "cleared").otherwise(F.col("status"))})
    return rows.select(*jobs.columns), left


def restore_job_dates(work: DataFrame, jobs_marks: DataFrame) -> DataFrame:
    """Give undated job lines the day written on their sheet, matched by client, name, amount and occurrence.

    jobs_marks: client_id, month, name, amount, day, pos.
    """
    key = ["month", "client_id", "__name", "__amount"]
    w = work.withColumns({"__name": F.lower("description"), "__amount": T.money(F.col("amount"))}).withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("id")))
    m = jobs_marks.withColumns({"__name": F.lower("name"), "__amount": T.money(F.col("amount"))}).withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("pos"))).select(*key, "__n", F.col("day").alias("__day"))
    joined = w.join(m, [*key, "__n"], "left")
    return joined.withColumn("day_or_note", F.coalesce("day_or_note", F.col("__day").cast("string"))).select(*work.columns)
