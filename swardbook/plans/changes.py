"""Queries and oracles: state changes, as the relations they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import state as S
from ..sources.fixtures import Ledger, with_tables

MONTH = "1996-03"
_CLIENT = ["id", "name", "email", "phone", "mow_price", "hedge_price", "hedge_roster", "prefer_mail", "delivery", "on_roster", "entity_kind"]
_WORK = ["id", "client_id", "month", "description", "amount", "source_job_id"]
_DOWN = "CASE WHEN id % 2 = 0 THEN NULL ELSE CAST(20 + id % 9 AS DECIMAL(12,2)) END"
#: Change sets as SQL that both engines run.
UPSERT = [
    ("SELECT '  ' || upper(name) AS name, 'n' || CAST(id AS STRING) || '@new' AS email, CASE WHEN id % 2 = 0 THEN NULL ELSE '860' END AS phone, " + _DOWN + " AS mow_price FROM clients WHERE id % 5 = 0"),
    "SELECT 'NEW, ' || lpad(CAST(id AS STRING), 8, '0') AS name, NULL AS email, '1' AS phone, CAST(9 AS DECIMAL(12,2)) AS mow_price FROM clients WHERE id % 50 = 0",
]
TYPED = f"SELECT id, 'Typed ' || CAST(id AS STRING) AS name, CAST(NULL AS STRING) AS address, phone, CAST(NULL AS STRING) AS email, billing_notes, mow_price, {_DOWN} AS hedge_price, id % 3 = 0 AS prefer_mail, true AS on_roster FROM clients WHERE id % 4 = 0"
PATCH = "SELECT id, CASE WHEN id % 2 = 0 THEN NULL ELSE ' P ' || CAST(id AS STRING) END AS name, CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN ' x@y ' ELSE NULL END AS email, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN '12.5' ELSE NULL END AS mow_price FROM clients WHERE id % 3 <> 0"
OFFICE = f"SELECT id, CASE WHEN id % 2 = 0 THEN NULL ELSE 'Office ' || CAST(id AS STRING) END AS name, CAST(NULL AS STRING) AS billing_notes, {_DOWN} AS hedge_price, id % 2 = 1 AS hedge_roster FROM clients WHERE id % 6 = 1"
RESENT = "SELECT 900000000 + id AS id, client_id, month, day_or_note, 'again' AS description, CAST(1 AS DECIMAL(12,2)) AS amount, source_job_id, created_at FROM work_items WHERE source_job_id IN ('job-3', 'job-5')"
ADDED = f"SELECT client_id, month, day_or_note, 'added' AS description, amount, id AS seq FROM work_items WHERE month = '{MONTH}'"
MOVES = "SELECT DISTINCT month, client_id AS source, client_id % 5 + 1 AS target FROM work_items WHERE client_id % 4 = 3"
MADE = "SELECT month, client_id, 'made/' || month || '/' || CAST(client_id AS STRING) AS s3_key FROM work_items GROUP BY month, client_id"
FACES = "SELECT id, CASE WHEN id % 2 = 0 THEN 'Roster' ELSE ' Own ' END AS name, 'Roster' AS roster_name, CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'r@x' ELSE 'o@x' END AS email, 'r@x' AS roster_email, CASE WHEN id % 2 = 0 THEN 'sms' ELSE 'mail' END AS delivery, 'mail' AS roster_delivery FROM bills WHERE id % 5 < 3"
JOBS = ["SELECT id, 'error' AS status, 'failed' AS progress_msg, CAST(NULL AS STRING) AS extract_json, '2001-01' AS month FROM jobs WHERE status = 'done'", "SELECT 'new-' || id AS id, 'queued' AS status, '' AS progress_msg, '{}' AS extract_json, CAST(NULL AS STRING) AS month FROM jobs WHERE status = 'error'"]
CLEARED = "SELECT id FROM jobs WHERE status <> 'error'"


def _from(led: Ledger, *sql: str) -> DataFrame:
    """Run change SQL over the ledger's relations."""
    frames = {"clients": led.clients, "work_items": led.work, "jobs": led.jobs, "bills": led.bills}
    out = None
    for text in sql:
        name = next(n for n in frames if f"FROM {n}" in text)
        part = led.spark.sql(text.replace(f"FROM {name}", "FROM {t}").replace("'{}'", "'{{}}'"), t=frames[name])
        out = part if out is None else out.unionByName(part)
    return out


def _jobs_after(led: Ledger):
    return S.clear_reviews(led.jobs, led.work, _from(led, CLEARED))


QUERIES = {
    "upsert_clients": lambda s, d: S.coalesce_clients((x := Ledger(s, d)).clients, _from(x, *UPSERT)).select(*_CLIENT),
    "save_typed_clients": lambda s, d: S.save_clients((x := Ledger(s, d)).clients, _from(x, TYPED)).select(*_CLIENT),
    "typed_name_clashes": lambda s, d: S.check_typed((x := Ledger(s, d)).clients, x.clients.select((F.col("id") + 1).alias("id"), "name")),
    "patch_clients": lambda s, d: S.patch_clients((x := Ledger(s, d)).clients, _from(x, PATCH)).select("id", "name", "email", "mow_price"),
    "office_overwrite": lambda s, d: S.office_clients((x := Ledger(s, d)).clients, _from(x, OFFICE)).select(*_CLIENT),
    "replace_job_lines": lambda s, d: S.replace_job_lines((x := Ledger(s, d)).work, _from(x, RESENT)).select(*_WORK),
    "insert_work": lambda s, d: S.insert_work((x := Ledger(s, d)).work, _from(x, ADDED), ["seq"]).select(*_WORK),
    "delete_sourced_month": lambda s, d: S.delete_sourced_month(Ledger(s, d).work, MONTH).select(*_WORK),
    "delete_month_work": lambda s, d: S.delete_month((x := Ledger(s, d)).work, x.bills, MONTH)[0].select(*_WORK),
    "delete_month_keys": lambda s, d: S.delete_month((x := Ledger(s, d)).work, x.bills, MONTH)[2],
    "delete_client_month": lambda s, d: S.delete_client_month((x := Ledger(s, d)).work, x.bills, MONTH, 7)[0].select(*_WORK),
    "delete_client": lambda s, d: S.delete_client((x := Ledger(s, d)).clients, x.work, x.bills, 7)[1].select(*_WORK),
    "reassign_work": lambda s, d: S.reassign((x := Ledger(s, d)).work, x.bills, _from(x, MOVES))[0].select(*_WORK),
    "reassign_bills": lambda s, d: S.reassign((x := Ledger(s, d)).work, x.bills, _from(x, MOVES))[1].select("id", "month", "client_id"),
    "upsert_bills": lambda s, d: S.upsert_bills((x := Ledger(s, d)).bills, _from(x, MADE)).select("id", "month", "client_id", "s3_key", "emailed_at"),
    "set_bill_face": lambda s, d: S.set_bill_face((x := Ledger(s, d)).bills, _from(x, FACES)).select("id", "display_name", "bill_email", "bill_delivery"),
    "upsert_jobs": lambda s, d: S.upsert_jobs((x := Ledger(s, d)).jobs, _from(x, *JOBS)).select("id", "status", "progress_msg", "extract_json", "month"),
    "clear_reviews": lambda s, d: _jobs_after(Ledger(s, d))[0].select("id", "status", "progress_msg"),
    "clear_reviews_work": lambda s, d: _jobs_after(Ledger(s, d))[1].select(*_WORK),
    "patch_work": lambda s, d: S.patch_work((x := Ledger(s, d)).work, x.work.filter("id % 5 = 0").select("id", F.lit(" new ").alias("description"), F.when(F.col("id") % 2 == 0, "").otherwise("7.25").alias("amount"), F.lit(None).cast("string").alias("month"))).select(*_WORK),
}

_c, _w = ", ".join(_CLIENT), ", ".join(_WORK)
_changed = lambda sql: f"n AS ({sql})"
_kept = lambda *own: ", ".join(next((o for o in own if o.endswith(f" AS {c}")), f"c.{c}") for c in _CLIENT)
ORACLES = {
    "upsert_clients": with_tables(
        f"""SELECT {_kept('coalesce(n.email, c.email) AS email', 'coalesce(n.phone, c.phone) AS phone', 'coalesce(n.mow_price, c.mow_price) AS mow_price')} FROM clients c LEFT JOIN n ON lower(trim(n.name)) = lower(trim(c.name))
UNION ALL SELECT (SELECT max(id) FROM clients) + row_number() OVER (ORDER BY name), trim(name), email, phone, mow_price, NULL, false, false, NULL, true, 'client' FROM n WHERE name LIKE 'NEW, %'""",
        _changed(" UNION ALL ".join(UPSERT)),
    ),
    "save_typed_clients": with_tables(
        f"""SELECT {_kept(*(f'CASE WHEN n.id IS NULL THEN c.{k} ELSE n.{k} END AS {k}' for k in ('name', 'email', 'phone', 'mow_price', 'hedge_price', 'prefer_mail', 'on_roster')), 'CASE WHEN n.id IS NULL THEN c.hedge_roster ELSE n.hedge_price IS NOT NULL END AS hedge_roster', "CASE WHEN n.id IS NULL THEN c.delivery WHEN n.prefer_mail THEN 'mail' WHEN c.delivery = 'mail' THEN NULL ELSE c.delivery END AS delivery")} FROM clients c LEFT JOIN n ON n.id = c.id""",
        _changed(TYPED),
    ),
    "typed_name_clashes": with_tables("SELECT id + 1 AS id, name, 'was not found' AS reason FROM clients WHERE id + 1 NOT IN (SELECT id FROM clients) UNION ALL SELECT id + 1, name, 'is already on file' FROM clients"),
    "patch_clients": with_tables(
        "SELECT c.id, CASE WHEN n.name IS NULL THEN c.name ELSE nullif(trim(n.name), '') END AS name, CASE WHEN n.email IS NULL THEN c.email ELSE nullif(trim(n.email), '') END AS email, CASE WHEN n.mow_price IS NULL THEN c.mow_price ELSE nullif(n.mow_price, '')::DECIMAL(12,2) END AS mow_price FROM clients c LEFT JOIN n ON n.id = c.id",
        _changed(PATCH),
    ),
    "office_overwrite": with_tables(f"SELECT {_kept('coalesce(n.name, c.name) AS name', 'CASE WHEN n.id IS NULL THEN c.hedge_price ELSE n.hedge_price END AS hedge_price', 'CASE WHEN n.id IS NULL THEN c.hedge_roster ELSE n.hedge_roster END AS hedge_roster')} FROM clients c LEFT JOIN n ON n.id = c.id", _changed(OFFICE)),
    "replace_job_lines": with_tables(f"SELECT {_w} FROM work_items w WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.month = w.month AND n.source_job_id = w.source_job_id) UNION ALL SELECT {_w} FROM n", _changed(RESENT)),
    "insert_work": with_tables(f"SELECT {_w} FROM work_items UNION ALL SELECT (SELECT max(id) FROM work_items) + row_number() OVER (ORDER BY seq), client_id, month, description, amount, NULL FROM n", _changed(ADDED)),
    "delete_sourced_month": with_tables(f"SELECT {_w} FROM work_items WHERE month <> '{MONTH}' OR source_job_id IS NULL"),
    "delete_month_work": with_tables(f"SELECT {_w} FROM work_items WHERE month <> '{MONTH}'"),
    "delete_month_keys": with_tables(f"SELECT s3_key FROM bills WHERE month = '{MONTH}'"),
    "delete_client_month": with_tables(f"SELECT {_w} FROM work_items WHERE NOT (month = '{MONTH}' AND client_id = 7)"),
    "delete_client": with_tables(f"SELECT {_w} FROM work_items WHERE client_id <> 7"),
    "reassign_work": with_tables(f"SELECT {_w.replace('client_id', 'coalesce((SELECT target FROM n WHERE n.month = w.month AND n.source = w.client_id), client_id) AS client_id')} FROM work_items w", _changed(MOVES)),
    "reassign_bills": with_tables(
        """SELECT b.id, b.month, coalesce(n.target, b.client_id) AS client_id FROM bills b LEFT JOIN n ON n.month = b.month AND n.source = b.client_id AND n.source <> n.target
WHERE n.target IS NULL OR NOT EXISTS (SELECT 1 FROM bills o WHERE o.month = b.month AND o.client_id = n.target)""",
        _changed(MOVES),
    ),
    "upsert_bills": with_tables(
        """SELECT b.id, b.month, b.client_id, n.s3_key, NULL::TIMESTAMP AS emailed_at FROM bills b JOIN n ON n.month = b.month AND n.client_id = b.client_id
UNION ALL SELECT (SELECT max(id) FROM bills) + row_number() OVER (ORDER BY month, client_id), month, client_id, s3_key, NULL FROM n WHERE NOT EXISTS (SELECT 1 FROM bills b WHERE n.month = b.month AND n.client_id = b.client_id)""",
        _changed(MADE),
    ),
    "set_bill_face": with_tables(
        """SELECT b.id, CASE WHEN n.id IS NULL THEN b.display_name WHEN trim(n.name) <> 'Roster' THEN trim(n.name) END AS display_name, CASE WHEN n.id IS NULL THEN b.bill_email WHEN n.email IS DISTINCT FROM 'r@x' THEN n.email END AS bill_email,
  CASE WHEN n.id IS NULL THEN b.bill_delivery WHEN n.delivery <> 'mail' THEN n.delivery END AS bill_delivery FROM bills b LEFT JOIN n ON n.id = b.id""",
        _changed(FACES),
    ),
    "upsert_jobs": with_tables("SELECT coalesce(j.id, n.id) AS id, coalesce(n.status, j.status) AS status, coalesce(n.progress_msg, j.progress_msg) AS progress_msg, coalesce(n.extract_json, j.extract_json) AS extract_json, coalesce(n.month, j.month) AS month FROM jobs j FULL JOIN n ON n.id = j.id", _changed(" UNION ALL ".join(JOBS))),
    "clear_reviews": with_tables("SELECT id, CASE WHEN status IN ('done', 'stored') THEN 'cleared' ELSE status END AS status, CASE WHEN status IN ('done', 'stored') THEN 'Review cleared' ELSE progress_msg END AS progress_msg FROM jobs"),
    "clear_reviews_work": with_tables(f"SELECT {_w} FROM work_items w WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.status = 'stored' AND j.id = w.source_job_id AND j.month = w.month)"),
    "patch_work": with_tables(f"SELECT {_w} FROM (SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN ' new ' ELSE description END AS description, CASE WHEN id % 10 = 0 THEN NULL WHEN id % 5 = 0 THEN 7.25 ELSE amount END::DECIMAL(12,2) AS amount) FROM work_items) w"),
}
