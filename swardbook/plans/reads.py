"""Queries and oracles: reads, predicates, names and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import views as V
from ..sources.fixtures import Ledger, with_tables

MONTH = "1996-03"
_ROSTER = "email, phone, address, billing_notes, mow_price, hedge_price, prefer_mail, delivery"
_EMAIL_SQL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
_WS = r"'^\s+|\s+$', '', 'g'"


def sql_strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), {_WS})"


def sql_contact(email: str = "email", notes: str = "billing_notes") -> str:
    return f"CASE WHEN contains({sql_strip(email)}, '@') THEN {sql_strip(email)} ELSE array_to_string(regexp_extract_all(coalesce({notes}, ''), '{_EMAIL_SQL}'), ', ') END"


def sql_channel(delivery: str = "delivery", email: str = "email") -> str:
    return (
        f"CASE WHEN lower({sql_strip(delivery)}) IN ('email', 'sms', 'mail') THEN lower({sql_strip(delivery)}) WHEN prefer_mail THEN 'mail' "
        f"WHEN contains({sql_contact(email)}, '@') THEN 'email' WHEN {sql_strip('phone')} <> '' THEN 'sms' ELSE 'mail' END"
    )


_LINES = f"SELECT w.id, w.client_id, w.month, w.day_or_note, w.description, w.amount, w.source_job_id, c.name AS client_name, {_ROSTER} FROM work_items w JOIN clients c ON w.client_id = c.id"
_BILLS = (
    f"SELECT b.id, b.month, b.client_id, b.display_name, b.bill_email, b.bill_delivery, b.emailed_at, f.first_work, c.name AS client_name, {_ROSTER} FROM bills b JOIN clients c ON b.client_id = c.id "
    "LEFT JOIN (SELECT month, client_id, min(id) AS first_work FROM work_items GROUP BY ALL) f ON f.month = b.month AND f.client_id = b.client_id"
)
_LINE_COLS = [c.strip() for c in f"id, client_id, month, day_or_note, description, amount, source_job_id, client_name, {_ROSTER}".split(",")]
_BILL_COLS = [c.strip() for c in f"id, month, client_id, display_name, bill_email, bill_delivery, emailed_at, first_work, client_name, {_ROSTER}".split(",")]
_FACED = f"""faced AS (SELECT * REPLACE (CASE WHEN {sql_strip('display_name')} <> '' THEN {sql_strip('display_name')} ELSE client_name END AS client_name,
  coalesce(bill_email, email) AS email, CASE WHEN lower({sql_strip('bill_delivery')}) IN ('email', 'sms', 'mail') THEN lower({sql_strip('bill_delivery')}) ELSE delivery END AS delivery) FROM ({_BILLS}) b)"""
_NEWEST = "ORDER BY updated_at DESC NULLS LAST, created_at DESC"
_PUBLIC = "id, coalesce(name, '') AS name, coalesce(address, '') AS address, coalesce(phone, '') AS phone, coalesce(email, '') AS email, coalesce(billing_notes, '') AS billing_notes, mow_price::DOUBLE AS mow_price, hedge_price::DOUBLE AS hedge_price, coalesce(prefer_mail, false) AS prefer_mail, coalesce(on_roster, true) AS on_roster"
_KNOWN = "name NOT ILIKE '%smoke%' AND on_roster"


def _bills(led: Ledger):
    return V.bills_for_month(led.bills, led.work, led.clients)


QUERIES = {
    "work_for_month": lambda s, d: V.work_for_month((x := Ledger(s, d)).work, x.clients, MONTH).select(*_LINE_COLS),
    "work_for_client_month": lambda s, d: V.work_for_month((x := Ledger(s, d)).work, x.clients, MONTH, 49).select(*_LINE_COLS),
    "bills_ordered": lambda s, d: _bills(Ledger(s, d)).select(*_BILL_COLS),
    "months_with_work": lambda s, d: V.months_with_work(Ledger(s, d).work),
    "month_inventory": lambda s, d: V.month_inventory((x := Ledger(s, d)).work, x.bills, x.jobs, MONTH).withColumn("jobs", F.coalesce(F.to_json("jobs"), F.lit("{}"))),
    "month_counts": lambda s, d: V.month_counts(Ledger(s, d).work),
    "month_work_count": lambda s, d: V.month_work_count(Ledger(s, d).work, MONTH),
    "bills_rev": lambda s, d: V.bills_rev(Ledger(s, d).bills, MONTH),
    "jobs_updated_at": lambda s, d: Ledger(s, d).jobs.agg(F.max("updated_at").alias("t")),
    "latest_bill_per_client": lambda s, d: V.latest_bills(Ledger(s, d).bills.unionByName(Ledger(s, d).bills.withColumn("id", F.col("id") + 1))).select("id", "month", "client_id"),
    "latest_job_status": lambda s, d: V.latest_job(Ledger(s, d).jobs).select("status"),
    "latest_job_month": lambda s, d: V.latest_calendar_job(Ledger(s, d).jobs).select("month"),
    "latest_job_per_user": lambda s, d: V.latest_per_key(Ledger(s, d).jobs, ["user_id"], *V.newest_first(), F.col("id")).select("user_id", "id", "status"),
    "top_editable_jobs": lambda s, d: V.editable_jobs(Ledger(s, d).jobs).select("id", "month", "status", "updated_at"),
    "roster_ordered": lambda s, d: V.roster(Ledger(s, d).clients).select("id", "name", "sort_order"),
    "roster_public": lambda s, d: V.public_roster(Ledger(s, d).clients),
    "sheet_clients_work": lambda s, d: V.sheet_clients(Ledger(s, d).clients, "work").select("id", "name"),
    "sheet_clients_hedges": lambda s, d: V.sheet_clients(Ledger(s, d).clients, "hedges").select("id", "name"),
    "sheet_clients_mowing": lambda s, d: V.sheet_clients(Ledger(s, d).clients).select("id", "name"),
    "sheet_clients_fallback": lambda s, d: V.sheet_clients(Ledger(s, d).clients.filter("mow_price IS NULL AND entity_kind = 'client'")).select("id", "name"),
    "client_by_name": lambda s, d: V.client_by_name(Ledger(s, d).clients, " keeler, KELLY 1041 ").select("id", "name"),
    "clients_by_ids": lambda s, d: V.by_ids(Ledger(s, d).clients, Ledger(s, d).work.filter(F.col("month") == MONTH).select("client_id")).select("id", "name"),
    "clients_with_work": lambda s, d: V.clients_with_work((x := Ledger(s, d)).clients, x.work).select("id"),
    "clients_without_work": lambda s, d: V.clients_without_work((x := Ledger(s, d)).clients, x.work.filter(F.col("month") == MONTH)).select("id"),
    "snapshot_work": lambda s, d: V.snapshot_work((x := Ledger(s, d)).work, x.clients),
    "snapshot_bills": lambda s, d: V.snapshot_bills((x := Ledger(s, d)).bills, x.clients),
    "office_coverage": lambda s, d: V.office_coverage(Ledger(s, d).clients),
    "set_up_clients": lambda s, d: Ledger(s, d).clients.select("id", V.is_set_up().alias("set_up"), V.has_prices().alias("priced")),
    "delivery_channel": lambda s, d: V.with_channel(Ledger(s, d).clients).select("id", "channel"),
    "contact_email": lambda s, d: Ledger(s, d).clients.select("id", T.contact_email(F.col("email"), F.col("billing_notes")).alias("contact")),
    "face_bill": lambda s, d: V.faced(_bills(Ledger(s, d))).select("id", "client_name", "email", "delivery"),
    "download_modes": lambda s, d: V.download(V.faced(_bills(Ledger(s, d))), "with_email").select("id", "channel"),
    "email_worklist": lambda s, d: V.email_worklist(V.faced(_bills(Ledger(s, d)))).select("id", F.array_join("to", ",").alias("recipients"), "action"),
    "recipient_addresses": lambda s, d: Ledger(s, d).table("documents").select("doc_id", F.array_join(T.addresses(F.col("text")), ",").alias("addresses")),
    "name_forms": lambda s, d: Ledger(s, d).clients.select("id", T.first_name(F.col("name")).alias("first"), T.person_name(F.col("name")).alias("person"), T.name_key(F.col("name")).alias("key"), T.norm_name(F.col("name")).alias("norm"), T.entity_kind(F.col("name")).alias("kind")),
    "money_labels": lambda s, d: Ledger(s, d).table("part").select("p_partkey", T.money_label(T.money(F.col("p_retailprice"))).alias("label"), T.money_label(T.money(F.floor("p_retailprice"))).alias("whole")),
    "ordinals": lambda s, d: Ledger(s, d).table("part").select("p_partkey", T.ordinal(F.col("p_size")).alias("ordinal")),
    "invoice_when": lambda s, d: Ledger(s, d).work.select("month").distinct().select("month", T.letter_date(F.col("month")).alias("letter"), T.month_name(F.col("month")).alias("name"), T.month_number(F.col("month")).alias("number"), T.month_label(F.col("month")).alias("label"), T.invoice_sentence(F.col("month"), F.lit(None).cast("string")).alias("sentence")),
    "work_month": lambda s, d: Ledger(s, d).table("orders").select("o_orderkey", T.work_month(F.to_date("o_orderdate")).alias("billed")),
    "billing_notes_parse": lambda s, d: Ledger(s, d).clients.select("id", T.note_email(F.col("billing_notes")).alias("email"), T.note_phone(F.col("billing_notes")).alias("phone"), F.upper(F.coalesce("billing_notes", F.lit(""))).contains("REGULAR MAIL").alias("paper"), T.notes_without_money(F.col("billing_notes")).alias("notes")),
    "locator_lines": lambda s, d: Ledger(s, d).clients.select("id", T.locator_line(F.col("name"), F.col("address"), F.col("phone"), F.col("email"), F.col("prefer_mail"), F.col("billing_notes")).alias("line")),
    "letter_defaults": lambda s, d: Ledger(s, d).bills.select("id", T.letter_or_default(F.col("cover_note"), F.lit("Usual")).alias("shown"), T.stored_letter(F.col("cover_note"), F.lit("Thanks")).alias("same"), T.stored_letter(F.col("cover_note"), F.lit("Usual")).alias("stored")),
    "inventory_tokens": lambda s, d: V.revisions((x := Ledger(s, d)).work, x.bills, x.jobs, MONTH).withColumnRenamed("clients_rev", "jobs_rev"),
}

_first = "trim(regexp_replace(coalesce(name, ''), '\\s+', ' ', 'g'))"
_given = f"CASE WHEN contains({_first}, ',') THEN trim(regexp_replace({_first}, '^[^,]*,', '')) WHEN len(string_split({_first}, ' ')) >= 2 AND upper(string_split({_first}, ' ')[1]) = string_split({_first}, ' ')[1] AND lower(string_split({_first}, ' ')[1]) <> string_split({_first}, ' ')[1] THEN string_split({_first}, ' ')[-1] ELSE {_first} END"
_word = f"list_filter(string_split({_given}, ' '), lambda w: w NOT IN ('&', 'and', ''))[1]"
_title = lambda c: f"array_to_string(list_transform(string_split({c}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_last = f"trim(regexp_extract({_first}, '^([^,]*),', 1))"
_p = "('PHONE')"
_PHONE_SQL = r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
_digits = f"regexp_replace(regexp_extract(coalesce(billing_notes, ''), '{_PHONE_SQL}'), '\\D', '', 'g')"
_NOTES = r"trim(regexp_replace(regexp_replace(coalesce(billing_notes, ''), '\$\s*\d+(?:\.\d+)?|\b\d+\.\d{2}\b', '', 'g'), '\s{2,}', ' ', 'g'), ' |;-')"
_MONTHS = "['January','February','March','April','May','June','July','August','September','October','November','December']"

ORACLES = {
    "work_for_month": with_tables(f"SELECT * FROM ({_LINES}) x WHERE month = '{MONTH}'"),
    "work_for_client_month": with_tables(f"SELECT * FROM ({_LINES}) x WHERE month = '{MONTH}' AND client_id = 49"),
    "bills_ordered": with_tables(_BILLS),
    "months_with_work": with_tables("SELECT DISTINCT month, regexp_matches(month, '^[0-9]{4}-[0-9]{2}$') AS calendar FROM work_items"),
    "month_inventory": with_tables(f"""SELECT '{MONTH}' AS month, (SELECT count(*) FROM work_items WHERE month = '{MONTH}') AS work, (SELECT count(*) FROM bills WHERE month = '{MONTH}') AS bills,
  (SELECT '{{' || coalesce(string_agg('"' || status || '":' || n, ',' ORDER BY status), '') || '}}' FROM (SELECT status, count(*) AS n FROM jobs WHERE month = '{MONTH}' GROUP BY status) j) AS jobs, (SELECT count(*) FROM work_items WHERE month = 'test_month') AS test_work"""),
    "month_counts": with_tables("SELECT month, count(*) AS n FROM work_items GROUP BY month"),
    "month_work_count": with_tables(f"SELECT count(*) AS n FROM work_items WHERE month = '{MONTH}'"),
    "bills_rev": with_tables(f"SELECT count(*) || ':' || coalesce(max(id), 0) || ':' || coalesce(strftime(max(emailed_at), '%Y-%m-%d %H:%M:%S'), 'None') AS rev FROM bills WHERE month = '{MONTH}'"),
    "jobs_updated_at": with_tables("SELECT max(updated_at) AS t FROM jobs"),
    "latest_bill_per_client": with_tables("SELECT max(id) + 1 AS id, month, client_id FROM bills GROUP BY month, client_id"),
    "latest_job_status": with_tables(f"SELECT status FROM jobs {_NEWEST} LIMIT 1"),
    "latest_job_month": with_tables(f"SELECT month FROM jobs WHERE regexp_matches(month, '^[0-9]{{4}}-[0-9]{{2}}$') {_NEWEST} LIMIT 1"),
    "latest_job_per_user": with_tables("SELECT user_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC NULLS LAST, created_at DESC, id) AS r FROM jobs) j WHERE r = 1"),
    "top_editable_jobs": with_tables(f"SELECT id, month, status, updated_at FROM jobs WHERE extract_json IS NOT NULL AND status IN ('done', 'stored') {_NEWEST} LIMIT 24"),
    "roster_ordered": with_tables("SELECT id, name, sort_order FROM clients"),
    "roster_public": with_tables(f"SELECT {_PUBLIC} FROM clients WHERE on_roster IS DISTINCT FROM false"),
    "sheet_clients_work": with_tables(f"SELECT id, name FROM clients WHERE {_KNOWN}"),
    "sheet_clients_hedges": with_tables(f"SELECT id, name FROM clients WHERE {_KNOWN} AND (hedge_roster OR hedge_price IS NOT NULL)"),
    "sheet_clients_mowing": with_tables(f"SELECT id, name FROM clients WHERE {_KNOWN} AND (mow_price IS NOT NULL OR entity_kind IN ('parcel', 'association'))"),
    "sheet_clients_fallback": with_tables(f"SELECT id, name FROM clients WHERE {_KNOWN} AND mow_price IS NULL AND entity_kind = 'client'"),
    "client_by_name": with_tables("SELECT id, name FROM clients WHERE lower(trim(name)) = 'keeler, kelly 1041'"),
    "clients_by_ids": with_tables(f"SELECT id, name FROM clients WHERE id IN (SELECT client_id FROM work_items WHERE month = '{MONTH}')"),
    "clients_with_work": with_tables("SELECT id FROM clients WHERE EXISTS (SELECT 1 FROM work_items w WHERE w.client_id = clients.id)"),
    "clients_without_work": with_tables(f"SELECT id FROM clients WHERE NOT EXISTS (SELECT 1 FROM work_items w WHERE w.client_id = clients.id AND w.month = '{MONTH}')"),
    "snapshot_work": with_tables("SELECT w.id, w.client_id, w.month, w.description, w.amount, c.name AS client_name FROM work_items w JOIN clients c ON c.id = w.client_id ORDER BY w.month DESC, c.name, w.id LIMIT 200"),
    "snapshot_bills": with_tables("SELECT b.id, b.month, b.client_id, c.name AS client_name, b.emailed_at IS NOT NULL AS emailed FROM bills b JOIN clients c ON c.id = b.client_id ORDER BY b.month DESC, c.name, b.id LIMIT 80"),
    "office_coverage": with_tables(f"SELECT count(*) AS clients, count(mow_price) AS with_mow_price, count(hedge_price) AS with_hedge_price, count(*) FILTER ({sql_strip('email')} <> '') AS with_email, count(*) FILTER ({sql_strip('phone')} <> '') AS with_phone, count(sort_order) AS with_order FROM clients"),
    "set_up_clients": with_tables("SELECT id, coalesce(prefer_mail, false) OR mow_price IS NOT NULL OR hedge_price IS NOT NULL OR " + " OR ".join(f"{sql_strip(c)} <> ''" for c in ("address", "email", "phone", "billing_notes")) + " AS set_up, mow_price IS NOT NULL OR hedge_price IS NOT NULL AS priced FROM clients"),
    "delivery_channel": with_tables(f"SELECT id, {sql_channel()} AS channel FROM clients"),
    "contact_email": with_tables(f"SELECT id, {sql_contact()} AS contact FROM clients"),
    "face_bill": with_tables("SELECT id, client_name, email, delivery FROM faced", _FACED),
    "download_modes": with_tables(f"SELECT * FROM (SELECT id, {sql_channel()} AS channel FROM faced) x WHERE channel = 'email'", _FACED),
    "email_worklist": with_tables(
        f"""SELECT id, array_to_string(addr, ',') AS recipients, CASE WHEN channel = 'email' AND emailed_at IS NULL AND len(addr) > 0 THEN 'send' ELSE 'skip' END AS action FROM (
  SELECT id, emailed_at, {sql_channel()} AS channel, regexp_extract_all({sql_contact()}, '{_EMAIL_SQL}') AS addr FROM faced) x""",
        _FACED,
    ),
    "recipient_addresses": rf"""WITH m AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_EMAIL_SQL}') AS a FROM documents),
f AS (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM m), k AS (SELECT doc_id, i, a[i] AS x FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, lower(a[i]) ORDER BY i) = 1)
SELECT doc_id, coalesce((SELECT string_agg(x, ',' ORDER BY i) FROM k WHERE k.doc_id = m.doc_id), '') AS addresses FROM m""",
    "name_forms": with_tables(
        f"""SELECT id, CASE WHEN {_word} IS NULL THEN 'Customer' WHEN upper({_word}) = {_word} AND lower({_word}) <> {_word} THEN {_title(_word)} ELSE {_word} END AS first,
  CASE WHEN contains({_first}, ',') THEN trim(trim(regexp_replace({_first}, '^[^,]*,', '')) || ' ' || CASE WHEN upper({_last}) = {_last} THEN {_title(_last)} ELSE {_last} END) ELSE {_first} END AS person,
  regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key, trim(regexp_replace(upper(name), '[^A-Z0-9]+', ' ', 'g')) AS norm, 'client' AS kind FROM clients"""
    ),
    "money_labels": "SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN '$' || p_retailprice::BIGINT ELSE '$' || round(p_retailprice::DECIMAL(18,6), 2)::DECIMAL(18,2)::VARCHAR END AS label, '$' || floor(p_retailprice)::BIGINT AS whole FROM part",
    "ordinals": "SELECT p_partkey, p_size || CASE WHEN p_size % 100 BETWEEN 10 AND 20 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal FROM part",
    "invoice_when": with_tables(
        f"SELECT month, {_MONTHS}[n % 12 + 1] || ' 1st, ' || (y + n // 12) AS letter, {_MONTHS}[n] AS name, n AS number, {_MONTHS}[n] || ' ' || y AS label, 'Below is the invoice for any work done in ' || {_MONTHS}[n] || '.' AS sentence FROM (SELECT DISTINCT month, substr(month, 1, 4)::INT AS y, substr(month, 6)::INT AS n FROM work_items) m"
    ),
    "work_month": "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) - INTERVAL 1 DAY, '%Y-%m') AS billed FROM orders",
    "billing_notes_parse": with_tables(
        rf"""SELECT id, nullif(regexp_extract(coalesce(billing_notes, ''), '[\w.+-]+@[\w.-]+\.\w+'), '') AS email,
  CASE WHEN {_digits} <> '' THEN substr({_digits}, 1, 3) || '-' || substr({_digits}, 4, 3) || '-' || substr({_digits}, 7, 4) END AS phone,
  contains(upper(coalesce(billing_notes, '')), 'REGULAR MAIL') AS paper, {_NOTES} AS notes FROM clients"""
    ),
    "locator_lines": with_tables(
        rf"""SELECT id, concat_ws(' — ', name, CASE WHEN coalesce(address, '') <> '' THEN 'service address: ' || address END, 'phone: ' || phone,
  CASE WHEN coalesce(email, '') <> '' THEN 'email: ' || email WHEN prefer_mail THEN 'billed by regular mail' END, 'work dates are not on file — read them from the sheet', CASE WHEN {_NOTES} <> '' THEN 'notes: ' || substr({_NOTES}, 1, 90) END) AS line FROM clients"""
    ),
    "letter_defaults": with_tables("SELECT id, coalesce(nullif(trim(cover_note), ''), 'Usual') AS shown, CASE WHEN trim(cover_note) NOT IN ('', 'Thanks') THEN trim(cover_note) END AS same, CASE WHEN trim(cover_note) NOT IN ('', 'Usual') THEN trim(cover_note) END AS stored FROM bills"),
    "inventory_tokens": with_tables(f"SELECT (SELECT count(*) FROM work_items WHERE month = '{MONTH}') AS work_rev, (SELECT count(*) || ':' || coalesce(max(id), 0) || ':' || coalesce(strftime(max(emailed_at), '%Y-%m-%d %H:%M:%S'), 'None') FROM bills WHERE month = '{MONTH}') AS bills_rev, (SELECT max(updated_at) FROM jobs) AS jobs_rev"),
}
