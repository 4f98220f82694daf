"""Reads over the ledger: joins, counts, latest rows, ordered lists.

The roster is joined without a hint: Spark broadcasts it while its size is under
spark.sql.autoBroadcastJoinThreshold and shuffles it beyond. Month filters reach
the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

CALENDAR = r"^[0-9]{4}-[0-9]{2}$"
_CLIENT = ("name", "email", "phone", "address", "billing_address", "billing_notes", "mow_price", "hedge_price", "prefer_mail", "delivery")


def work_for_month(work: DataFrame, clients: DataFrame, month: str | None = None, client_id: int | None = None) -> DataFrame:
    """Work lines with their client, in order of id; of one month, and one client, if given."""
    if month is not None:
        work = work.filter(F.col("month") == month)
    if client_id is not None:
        work = work.filter(F.col("client_id") == client_id)
    names = clients.select(F.col("id").alias("__c"), F.col("name").alias("client_name"), *(c for c in _CLIENT if c != "name"))
    return work.join(names, F.col("client_id") == F.col("__c")).drop("__c").orderBy("id")


def bills_for_month(bills: DataFrame, work: DataFrame, clients: DataFrame, month: str | None = None) -> DataFrame:
    """Bills with client and first work line, by that line (bills without work last), then id."""
    if month is not None:
        bills, work = bills.filter(F.col("month") == month), work.filter(F.col("month") == month)
    first = work.groupBy(F.col("month").alias("__m"), F.col("client_id").alias("__c")).agg(F.min("id").alias("first_work"))
    names = clients.select(F.col("id").alias("__id"), F.col("name").alias("client_name"), *(c for c in _CLIENT if c != "name"))
    rows = bills.join(names, F.col("client_id") == F.col("__id")).join(first, (F.col("month") == F.col("__m")) & (F.col("client_id") == F.col("__c")), "left")
    return rows.drop("__id", "__m", "__c").orderBy(F.col("first_work").asc_nulls_last(), "id")


def months_with_work(work: DataFrame) -> DataFrame:
    """Distinct months: calendar months from the latest on, then other labels by name."""
    calendar = F.col("month").rlike(CALENDAR)
    months = work.select("month").distinct().withColumn("calendar", calendar)
    return months.orderBy(F.desc("calendar"), F.when(calendar, F.col("month")).desc(), F.when(~calendar, F.col("month")).asc())


def month_inventory(work: DataFrame, bills: DataFrame, jobs: DataFrame, month: str, test_month: str = "test_month") -> DataFrame:
    """One row: counts of work, bills, jobs by status, and work of the test month."""
    w = work.filter(F.col("month").isin(month, test_month)).agg(F.count_if(F.col("month") == month).alias("work"), F.count_if(F.col("month") == test_month).alias("test_work"))
    b = bills.filter(F.col("month") == month).agg(F.count("*").alias("bills"))
    by_status = jobs.filter(F.col("month") == month).groupBy("status").agg(F.count("*").alias("n"))
    j = by_status.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("jobs"))
    return w.crossJoin(b).crossJoin(j).select(F.lit(month).alias("month"), "work", "bills", "jobs", "test_work")  # one row each


def month_counts(work: DataFrame) -> DataFrame:
    return work.groupBy("month").agg(F.count("*").alias("n"))


def month_work_count(work: DataFrame, month: str) -> DataFrame:
    return work.filter(F.col("month") == month).agg(F.count("*").alias("n"))


def bills_rev(bills: DataFrame, month: str) -> DataFrame:
    """count:largest id:last sending, which changes when any bill of the month does."""
    last = F.coalesce(F.date_format(F.max("emailed_at"), "yyyy-MM-dd HH:mm:ss"), F.lit("None"))
    return bills.filter(F.col("month") == month).agg(F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.max("id"), F.lit(0)).cast("string"), last).alias("rev"))


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def latest_bills(bills: DataFrame) -> DataFrame:
    """The bill with the largest id of each (month, client)."""
    return latest_per_key(bills, ["month", "client_id"], F.desc("id"))


def newest_first() -> tuple[Column, Column]:
    return F.col("updated_at").desc_nulls_last(), F.col("created_at").desc()


def latest_job(jobs: DataFrame, month: str | None = None) -> DataFrame:
    """The job changed last, of one month if given."""
    rows = jobs if month is None else jobs.filter(F.col("month") == month)
    return rows.orderBy(*newest_first()).limit(1)


def latest_calendar_job(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("month").rlike(CALENDAR)).orderBy(*newest_first()).limit(1)


def editable_jobs(jobs: DataFrame, most: int = 24) -> DataFrame:
    """The newest jobs with a review table; the number is part of the feature."""
    return jobs.filter(F.col("extract_json").isNotNull() & F.col("status").isin("done", "stored")).orderBy(*newest_first()).limit(most)


def roster(clients: DataFrame) -> DataFrame:
    return clients.orderBy(F.col("sort_order").asc_nulls_last(), "name")


def public_roster(clients: DataFrame) -> DataFrame:
    """Client fields for display: blank for null text, prices as numbers; those off the roster are left out."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    number = lambda c: F.col(c).cast("double").alias(c)
    flag = lambda c, default: F.coalesce(c, F.lit(default)).alias(c)
    shown = clients.filter(F.coalesce("on_roster", F.lit(True)))
    return shown.select("id", text("name"), text("address"), text("phone"), text("email"), text("billing_notes"), number("mow_price"), number("hedge_price"), flag("prefer_mail", False), flag("on_roster", True))


def sheet_clients(clients: DataFrame, kind: str = "mowing") -> DataFrame:
    """Clients that guide a sheet's reading. A mowing list without prices falls back to the whole roster."""
    base = clients.filter(~F.col("name").ilike("%smoke%") & F.col("on_roster"))
    kind = (kind or "mowing").strip().lower()
    if kind == "hedges":
        base = base.filter(F.col("hedge_roster") | F.col("hedge_price").isNotNull())
    elif kind not in ("work", "work_completed", "other"):
        priced = F.col("mow_price").isNotNull() | F.col("entity_kind").isin("parcel", "association")
        some = base.agg(F.coalesce(F.bool_or(priced), F.lit(False)).alias("__some"))
        base = base.crossJoin(F.broadcast(some)).filter(F.coalesce(priced, F.lit(False)) | ~F.col("__some")).drop("__some")  # some is one row
    return roster(base)


def search_roster(clients: DataFrame, query: str) -> DataFrame:
    """Clients whose name and address hold a text, in any case; all of them for a blank one."""
    wanted = (query or "").strip().lower()
    blob = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("address", F.lit(""))))
    return clients.filter(blob.contains(wanted)) if wanted else clients


def roster_names(clients: DataFrame) -> DataFrame:
    """The roster's names in its order."""
    return roster(clients).select("name")


def knowledge_records(clients: DataFrame) -> DataFrame:
    """What a sheet's reading is given of each client: texts, and blank for null; prices as numbers."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return clients.select("id", text("name"), text("address"), text("phone"), text("email"), text("billing_notes"), F.coalesce("prefer_mail", F.lit(False)).alias("prefer_mail"), *(F.col(c).cast("double").alias(c) for c in ("mow_price", "hedge_price")))


def records_for_names(clients: DataFrame, names: DataFrame) -> DataFrame:
    """Clients with one of some names, in any case and without outer blanks; if there is none, the names themselves."""
    wanted = names.select(F.lower(F.trim("name")).alias("__name")).distinct()
    found = clients.join(wanted, F.lower(F.trim(F.coalesce("name", F.lit("")))) == F.col("__name"), "left_semi")
    none = found.agg((F.count("*") == 0).alias("__none"))
    given = names.filter(F.trim("name") != "").select("name").crossJoin(F.broadcast(none)).filter("__none").drop("__none")  # none is one row
    return found.unionByName(given, allowMissingColumns=True)


def job_by_id(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.filter(F.col("id") == job_id)


def has_email() -> Column:
    """A client or bill that mail can be sent to: a field or a note with an address."""
    return F.size(T.addresses(T.contact_email(F.col("email"), F.col("billing_notes")))) > 0


def client_by_name(clients: DataFrame, name: str) -> DataFrame:
    return clients.filter(F.lower(F.trim("name")) == F.lower(F.trim(F.lit(name))))


def by_ids(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id is among the given ones."""
    return df.join(ids.select(F.col(ids.columns[0]).alias("__id")), F.col(column) == F.col("__id"), "left_semi")


def clients_with_work(clients: DataFrame, work: DataFrame) -> DataFrame:
    return clients.join(work.select("client_id"), F.col("id") == F.col("client_id"), "left_semi")


def clients_without_work(clients: DataFrame, work: DataFrame) -> DataFrame:
    return clients.join(work.select("client_id"), F.col("id") == F.col("client_id"), "left_anti")


def snapshot_work(work: DataFrame, clients: DataFrame, most: int = 200) -> DataFrame:
    names = clients.select(F.col("id").alias("__c"), F.col("name").alias("client_name"))
    rows = work.join(names, F.col("client_id") == F.col("__c")).select("id", "client_id", "month", "description", "amount", "client_name")
    return rows.orderBy(F.desc("month"), "client_name", "id").limit(most)


def snapshot_bills(bills: DataFrame, clients: DataFrame, most: int = 80) -> DataFrame:
    names = clients.select(F.col("id").alias("__c"), F.col("name").alias("client_name"))
    rows = bills.join(names, F.col("client_id") == F.col("__c")).select("id", "month", "client_id", "client_name", F.col("emailed_at").isNotNull().alias("emailed"))
    return rows.orderBy(F.desc("month"), "client_name", "id").limit(most)


def office_coverage(clients: DataFrame) -> DataFrame:
    """How much of the roster is filled in, one pass."""
    filled = lambda c: F.count_if(T.strip(F.col(c)) != "").alias(f"with_{c}")
    return clients.agg(F.count("*").alias("clients"), F.count("mow_price").alias("with_mow_price"), F.count("hedge_price").alias("with_hedge_price"), filled("email"), filled("phone"), F.count("sort_order").alias("with_order"))


def has_prices() -> Column:
    return F.col("mow_price").isNotNull() | F.col("hedge_price").isNotNull()


def is_set_up() -> Column:
    """A roster row with a price, paper mail or any contact text."""
    some = F.lit(False)
    for c in ("address", "email", "phone", "billing_notes"):
        some = some | (T.strip(F.col(c)) != "")
    return F.coalesce("prefer_mail", F.lit(False)) | has_prices() | some


def with_channel(df: DataFrame) -> DataFrame:
    return df.withColumn("channel", T.delivery_channel(F.col("delivery"), F.col("prefer_mail"), F.col("email"), F.col("billing_notes"), F.col("phone")))


def faced(bills: DataFrame) -> DataFrame:
    """This month's name, email and delivery of a bill where it has its own."""
    choice = F.lower(T.strip(F.col("bill_delivery")))
    return bills.withColumns({
        "client_name": F.coalesce(T.blank_to_null(F.col("display_name")), F.col("client_name")),
        "email": F.coalesce(F.col("bill_email"), F.col("email")),
        "delivery": F.when(choice.isin(*T.CHANNELS), choice).otherwise(F.col("delivery")),
    })


MODES = {"mailing_only": "mail", "sms_only": "sms", "with_email": "email"}


def download(bills: DataFrame, mode: str = "all") -> DataFrame:
    """Bills of one delivery mode."""
    rows = with_channel(bills)
    return rows.filter(F.col("channel") == MODES[mode]) if mode in MODES else rows


def email_worklist(bills: DataFrame) -> DataFrame:
    """Bills with to: addresses to send to now, and action: send or skip."""
    to = T.addresses(T.contact_email(F.col("email"), F.col("billing_notes")))
    rows = with_channel(bills).withColumn("to", to)
    send = (F.col("channel") == "email") & F.col("emailed_at").isNull() & (F.size("to") > 0)
    return rows.withColumn("action", F.when(send, "send").otherwise("skip"))


def revisions(work: DataFrame, bills: DataFrame, clients: DataFrame, month: str) -> DataFrame:
    """Change tokens of a month, one row."""
    w = month_work_count(work, month).select(F.col("n").alias("work_rev"))
    b = bills_rev(bills, month).select(F.col("rev").alias("bills_rev"))
    c = clients.agg(F.max("updated_at").alias("clients_rev"))
    return w.crossJoin(b).crossJoin(c)  # one row each
