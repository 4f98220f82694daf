"""From reviewed sheets to stored work lines, set-wise for any number of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.marks import with_marks
from . import linkage, sheets, state
from .numbering import numbered, prefix
from .once import once


def mark_lines(cells: DataFrame, keep: list[str]) -> DataFrame:
    """Lines of work cells: keep, pos, day_or_note, description, amount. cells: keep, work, mow_price, hedge_price.

    Days are priced from the roster (nothing on file: 0), jobs from the cell; notes store nothing.
    """
    rows = with_marks(cells, "work", "__found").select(*keep, "mow_price", "hedge_price", F.posexplode_outer("__found").alias("pos", "m")).filter("m.kind <> 'note'")
    kind, day = F.col("m.kind"), F.col("m.day").cast("string")
    rate = F.when(kind == "mow", F.col("mow_price")).when(kind == "hedge", F.col("hedge_price"))
    return rows.select(
        *keep,
        "pos",
        F.when(kind == "hedge", F.concat(day, F.lit("h"))).otherwise(day).alias("day_or_note"),
        F.substring(F.when(kind == "mow", F.concat(F.lit("Mowing "), day)).when(kind == "hedge", F.concat(F.lit("Hedging "), day)).otherwise(F.col("m.name")), 1, 500).alias("description"),
        F.when(kind == "custom", F.col("m.amount").cast("decimal(12,2)")).otherwise(F.coalesce(rate.cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)"))).alias("amount"),
    )


def settle(rows: DataFrame, clients: DataFrame, resolutions: DataFrame, filed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with client_id, clients with those that resolutions add).

    rows: name and anything else. filed: sheet_name, client_id. resolutions: name, save_as, match_client_id,
    address, phone, email, billing_notes, mow_price, hedge_price, prefer_mail,
    add_permanently.
    """
    from ..functions import text as T

    answers = resolutions.withColumns({"__key": T.name_key(F.col("name")), "__save": F.coalesce(T.blank_to_null(F.col("save_as")), F.col("name"))})
    known = clients.select(F.col("id").alias("__known"), T.name_key(F.col("name")).alias("__known_key"))
    new = answers.filter("match_client_id IS NULL").withColumn("__save_key", T.name_key(F.col("__save")))
    new = new.join(known, F.col("__save_key") == F.col("__known_key"), "left_anti")
    text = lambda c: T.blank_to_null(F.col(c)).alias(c)
    added = new.dropDuplicates(["__save_key"]).select(
        F.col("__save").alias("name"), text("address"), text("phone"), text("email"), text("billing_notes"), F.col("mow_price").cast("decimal(12,2)").alias("mow_price"), F.col("hedge_price").cast("decimal(12,2)").alias("hedge_price"),
        F.col("hedge_price").isNotNull().alias("hedge_roster"), F.coalesce("prefer_mail", F.lit(False)).alias("prefer_mail"), F.coalesce("add_permanently", F.lit(False)).alias("on_roster"), F.when(F.col("prefer_mail"), "mail").alias("delivery"),
    )
    after = clients.unionByName(state.next_ids(clients, added, ["name"]), allowMissingColumns=True)
    by_key = after.groupBy(T.name_key(F.col("name")).alias("__owner_key")).agg(F.min("id").alias("__owner"))
    answers = answers.join(by_key, T.name_key(F.col("__save")) == F.col("__owner_key"), "left").select("__key", F.coalesce(F.col("match_client_id"), F.col("__owner")).alias("__answer")).dropDuplicates(["__key"])
    own = rows.join(filed, F.col("name") == F.col("sheet_name"), "left").drop("sheet_name").join(answers, T.name_key(F.col("name")) == F.col("__key"), "left")
    return own.withColumn("client_id", F.coalesce("client_id", "__answer")).drop("__key", "__answer"), after


def confirm(jobs: DataFrame, clients: DataFrame, work: DataFrame, resolutions: DataFrame | None = None, wipe: bool = True) -> dict[str, DataFrame]:
    """File reviewed jobs (id, month, extract_json): {conflicts, clients, work}.

    While conflicts has rows, clients and work are as before: the gate is a
    filter on the number of open names. Sheet rows, filed names, open names and
    new lines are read several times, so each is checkpointed when it is made. Lines that a job stored before
    are replaced. Every name of every job is filed against the same roster; names
    added by a resolution are added once.
    """
    parsed = sheets.parse(jobs)
    rows = once(sheets.extract_rows(parsed).join(jobs.select("id", "month"), "id").withColumn("seq", F.struct("id", "table_no", "row_no")))
    known = once(linkage.file_clients(rows.select(F.col("name").alias("sheet_name")), clients))
    open_names = once(linkage.open_conflicts(rows.select("seq", "name", "work"), clients, resolutions, known))
    gate = open_names.agg((F.count("*") == 0).alias("__clear"))
    if resolutions is None:
        filed, after = rows.join(known, F.col("name") == F.col("sheet_name"), "left").drop("sheet_name"), clients
    else:
        filed, after = settle(rows, clients, resolutions, known)
    priced = after.select(F.col("id").alias("__c"), "mow_price", "hedge_price")
    cells = filed.join(priced, F.col("client_id") == F.col("__c")).drop("__c").crossJoin(F.broadcast(gate)).filter("__clear")  # gate is one row
    lines = mark_lines(cells, ["id", "month", "client_id", "table_no", "row_no"])
    lines = once(lines.withColumnRenamed("id", "source_job_id"))
    order = ["source_job_id", "table_no", "row_no", "pos"]
    sent = jobs.select(F.col("id").alias("__j"), F.col("month").alias("__m")).crossJoin(F.broadcast(gate)).filter("__clear")
    kept = work.join(sent, (F.col("source_job_id") == F.col("__j")) & (F.col("month") == F.col("__m")), "left_anti") if wipe else work
    top = work.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    placed = numbered(lines, "__rank", order, [prefix(F.col("source_job_id"), 8)])
    new = placed.crossJoin(F.broadcast(top)).select((F.col("__top") + F.col("__rank")).cast("long").alias("id"), "client_id", "month", "day_or_note", "description", "amount", "source_job_id")  # top is one row
    return {"conflicts": open_names, "clients": after, "work": kept.unionByName(new, allowMissingColumns=True)}


def rebuild_month(jobs: DataFrame, clients: DataFrame, work: DataFrame, month: str, resolutions: DataFrame | None = None) -> dict[str, DataFrame]:
    """Replay all stored sheets of a month over its hand-typed lines.

    The month's own stored jobs are replayed, however many there are; a list cut
    to the newest few of all months would lose the others' lines.
    """
    stored = jobs.filter((F.col("status") == "stored") & (F.col("month") == month) & F.col("extract_json").isNotNull())
    return confirm(stored, clients, state.delete_sourced_month(work, month), resolutions, wipe=False)
