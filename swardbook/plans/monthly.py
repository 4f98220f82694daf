"""Queries and oracles: whole-month bills, the editor, table choice, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bills as B
from ..operators import sheets as S
from ..sources.fixtures import Ledger, with_tables
from .billing import DECODED
from .linking import MONTH, named_clients, sheet_jobs, sql_sheets
from .reads import sql_channel, sql_strip

_HERE = f"here AS (SELECT DISTINCT client_id FROM work_items WHERE month = '{MONTH}' AND source_job_id IS NULL UNION SELECT client_id FROM sheet_lines WHERE m = '{MONTH}')"


def _sheet(led: Ledger):
    """A narrow name list beside a wide table with short names, for each supplier."""
    n = F.col("s_suppkey").cast("string")
    text = F.concat(
        F.lit('{"tables":[{"columns":["Name"],"rows":[["SMITH, Mary '), n, F.lit('"],["BRADY, Jim '), n, F.lit('"]]},{"columns":["Address","x","y"],"rows":[["SMITH","1","2"],["BRADY","","3"]]},{"columns":["a","b","c","d"],"rows":[["","","",""],["1","","",""]]}]}')
    )
    return led.table("supplier").select("s_suppkey", F.from_json(text, S.EXTRACT).alias("sheet"))


def _names(led: Ledger):
    o = led.table("orders").select(F.floor(F.col("o_orderkey") / 8).cast("string").alias("sheet"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("CLIENTELE"), F.col("o_orderkey").cast("string"), F.lit(", Jo")).alias("name"))
    return o, o.filter("seq % 3 <> 0").withColumns({"work": F.lit("9 16"), "seq": -F.col("seq")})


def _generated(led: Ledger):
    """A month with stored sheets; every client is priced and on the roster, so names file under themselves."""
    clients = named_clients(led).withColumns({"mow_price": F.coalesce("mow_price", F.lit(20).cast("decimal(12,2)")), "on_roster": F.lit(True)})
    return B.generate_month(clients, led.work, led.bills, sheet_jobs(led, 400), MONTH)


QUERIES = {
    "editable_bills": lambda s, d: B.editable_bills((x := Ledger(s, d)).clients, x.bills, MONTH).select("client_id", "client_name", "email", "delivery", "bill_id", "intro", "closing"),
    "generate_month_bills": lambda s, d: _generated(Ledger(s, d))["bills"].select("month", "client_id", "emailed_at"),
    "generate_month_work": lambda s, d: _generated(Ledger(s, d))["work"].select("month", "client_id", "source_job_id", "day_or_note"),
    "knowledge_leaks": lambda s, d: B.leaks(Ledger(s, d).clients.withColumn("billing_notes", F.when(F.col("id") % 9 == 0, "Crossed out 5").otherwise(F.col("billing_notes")))).select("id", "phrase", "priced"),
    "preferred_table": lambda s, d: _sheet(Ledger(s, d)).select("s_suppkey", S.preferred_table(F.col("sheet")).alias("t")).select("s_suppkey", F.array_join("t.columns", "|").alias("columns"), F.posexplode("t.rows").alias("row_no", "r")).select("s_suppkey", "columns", "row_no", F.array_join("r", "|").alias("cells")),
    "assembled_rows": lambda s, d: S.assemble(*_names(Ledger(s, d))),
    "column_roles": lambda s, d: Ledger(s, d).table("part").select("p_partkey", S.column_role(F.concat("p_name", F.element_at(F.array(*map(F.lit, (" price", " work price", " client", " notes", " address", ""))), (F.col("p_partkey") % 6 + 1).cast("int")))).alias("role")),
}
ORACLES = {
    "editable_bills": with_tables(
        f"""SELECT c.id AS client_id, coalesce(nullif({sql_strip('b.display_name')}, ''), c.name) AS client_name, coalesce(b.bill_email, c.email, '') AS email, CASE WHEN lower({sql_strip('b.bill_delivery')}) IN ('email', 'sms', 'mail') THEN lower({sql_strip('b.bill_delivery')}) ELSE {sql_channel()} END AS delivery,
  b.id AS bill_id, coalesce(nullif(trim(b.cover_note), ''), 'Below is the invoice for any work done in March.') AS intro, '{B.CLOSING}' AS closing FROM clients c LEFT JOIN bills b ON b.client_id = c.id AND b.month = '{MONTH}'"""
    ),
    "generate_month_bills": with_tables(f"""SELECT b.month, b.client_id, CASE WHEN b.month = '{MONTH}' AND b.client_id IN (SELECT client_id FROM here) THEN NULL ELSE emailed_at END AS emailed_at FROM bills b
UNION ALL SELECT '{MONTH}', client_id, NULL FROM here WHERE client_id NOT IN (SELECT client_id FROM bills WHERE month = '{MONTH}')""", *sql_sheets(400), _HERE),
    "generate_month_work": with_tables(f"""SELECT month, client_id, source_job_id, day_or_note FROM work_items WHERE month <> '{MONTH}'
UNION ALL SELECT month, client_id, source_job_id, day_or_note FROM (SELECT *, row_number() OVER (PARTITION BY client_id, CASE WHEN role = 'visit' AND label IN ('Mowing', 'Hedging') AND day IS NOT NULL THEN label || day ELSE '#' || id END ORDER BY id) AS r FROM decoded WHERE month = '{MONTH}' AND source_job_id IS NULL) t WHERE r = 1
UNION ALL SELECT * FROM (SELECT m, client_id, min(id), note FROM (SELECT l.*, s.event_id FROM sheet_lines l JOIN sent s ON s.id = l.id WHERE l.m = '{MONTH}') k GROUP BY m, client_id, note)""", *sql_sheets(400), DECODED),
    "knowledge_leaks": with_tables("SELECT id, true AS phrase, false AS priced FROM clients WHERE id % 9 = 0"),
    "preferred_table": """SELECT s_suppkey, 'Contact|x|y' AS columns, i::INT AS row_no, CASE i WHEN 0 THEN 'SMITH, Mary ' || s_suppkey || '|1|2' ELSE 'BRADY, Jim ' || s_suppkey || '||3' END AS cells FROM supplier, (VALUES (0), (1)) v(i)""",
    "assembled_rows": """SELECT (o_orderkey // 8)::VARCHAR AS sheet, row_number() OVER (PARTITION BY o_orderkey // 8 ORDER BY o_orderkey) - 1 AS seq, 'CLIENTELE' || o_orderkey || ', Jo' AS name, '9 16' AS work FROM orders WHERE o_orderkey % 3 <> 0""",
    "column_roles": """SELECT p_partkey, CASE WHEN regexp_matches(t, 'contact|client|name') THEN 'name' WHEN regexp_matches(t, 'price|hedge|lawn|amount') AND NOT regexp_matches(t, 'work|date') THEN 'price' WHEN regexp_matches(t, 'date|work|day|completed') THEN 'work'
  WHEN regexp_matches(t, 'note|billing') THEN 'notes' WHEN contains(t, 'address') THEN 'address' ELSE '' END AS role FROM (SELECT p_partkey, lower(p_name || [' price', ' work price', ' client', ' notes', ' address', ''][p_partkey % 6 + 1]) AS t FROM part) x""",
}
