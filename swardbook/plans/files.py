"""Queries and oracles over office files and over the line log, both made of the ledger's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as M
from ..sources import documents as D
from ..sources.fixtures import Ledger, with_tables
from ..streaming import ingest as G

#: Rows of a file.
SIZE = 500


def _text(name: str):
    return F.col(name).cast("string")


def workbooks(led: Ledger):
    """Client lists as workbooks, some hundred rows each."""
    none = F.lit(None).cast("string")
    cells = F.array("name", "address", none, none, _text("mow_price"), "billing_notes")
    rows = led.clients.select("id", cells.alias("cells"))
    return D.packed(rows, D.workbook, F.concat(F.lit("clients-"), F.floor(F.col("id") / SIZE).cast("string"), F.lit(".xlsx")), F.col("id"), ["CLIENT", "ADDRESS", "2024", "2025", "2026", "BILLING"])


def order_tables(led: Ledger):
    """The order of work as Word tables, a file for each nation: names in capitals, every second with a place in brackets."""
    s = led.table("supplier")
    name = F.concat(F.upper("s_name"), F.when(F.col("s_suppkey") % 2 == 0, " (upper)").otherwise(""))
    rows = s.select("s_nationkey", "s_suppkey", F.array(name, F.lit("x")).alias("cells"))
    return D.packed(rows, D.word_table, _text("s_nationkey"), F.col("s_suppkey"), ["CLIENT", "WORK"])


def label_tables(led: Ledger):
    """Mailing labels as Word tables of two columns, the second empty."""
    label = F.concat(F.lit("KEY"), _text("s_suppkey"), F.lit(", Jo\n"), _text("s_suppkey"), F.lit(" Neck Rd\n  Old Town "))
    rows = led.table("supplier").select("s_suppkey", F.array(label, F.lit("")).alias("cells"))
    return D.packed(rows, D.word_table, F.floor(F.col("s_suppkey") / SIZE).cast("string"), F.col("s_suppkey"))


def asked(led: Ledger):
    """Names to look up: as on the label, another given name of the surname, and no label's."""
    n = _text("s_suppkey")
    names = F.element_at(F.array(F.concat(F.lit("Key"), n, F.lit(", JO")), F.concat(F.lit("KEY"), n, F.lit(", Al")), F.concat(F.lit("KEY"), n, F.lit(" Al"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return led.table("supplier").select(names.alias("name"))


def log(led: Ledger):
    """A log of lines: two or three sends of each job, typed lines that come twice, and ids that several lines claim."""
    w = led.work
    at = lambda days: F.to_timestamp(F.col("created_at")) + F.make_interval(days=F.lit(days))
    line = lambda send, days, origin, position: w.select(
        F.when(F.col("id") % 3 == 0, F.floor(F.col("id") / 100)).cast("long").alias("id"), "client_id", "month", "day_or_note", F.concat_ws(" ", F.lit(send), "description").alias("description"),
        "amount", "source_job_id", F.to_timestamp("created_at").cast("timestamp_ntz").alias("created_at"), F.lit(send).alias("send"), position.alias("position"), F.lit(origin).alias("origin"),
        at(days).alias("arrived"), F.concat(F.lit("b"), F.lit(str(days))).alias("batch"),
    )
    first, again, second = (line(s, d, "", F.col("id")) for s, d in (("s1", 0), ("s1", 900), ("s2", 40)))
    jobs = "source_job_id IS NOT NULL"
    # The first send of some jobs is read once more, long after; the second send of others is newer.
    return first.union(again.filter(f"{jobs} AND client_id % 5 = 0")).union(second.filter(f"{jobs} AND client_id % 7 = 0")).union(again.filter("source_job_id IS NULL"))


QUERIES = {
    "workbook_roster": lambda s, d: D.roster(workbooks(Ledger(s, d))).select("name", "address", "mow_price", "email", "prefer_mail", "billing_notes"),
    "word_table_order": lambda s, d: D.row_order(order_tables(Ledger(s, d))),
    "word_table_labels": lambda s, d: D.labels(label_tables(Ledger(s, d))),
    "label_lookup": lambda s, d: M.lookup(asked(x := Ledger(s, d)), D.labels(label_tables(x)), "billing_address", "to").select("name", "to"),
    "settled_log": lambda s, d: G.settled(log(Ledger(s, d))).select("id", "client_id", "month", "description", "source_job_id", "position"),
}

_LINE = """SELECT CASE WHEN id % 3 = 0 THEN id // 100 END AS given, id AS position, client_id, month, '{0} ' || coalesce(description, '') AS description, source_job_id, '{0}' AS send, created_at::TIMESTAMP + INTERVAL {1} DAY AS arrived FROM work_items"""
ORACLES = {
    "workbook_roster": with_tables(
        r"""SELECT name, nullif(trim(address), '') AS address, mow_price, nullif(regexp_extract(coalesce(billing_notes, ''), '[\w.+-]+@[\w.-]+\.\w+'), '') AS email,
  contains(upper(coalesce(billing_notes, '')), 'REGULAR MAIL') AS prefer_mail, billing_notes FROM clients"""
    ),
    "word_table_order": """WITH p AS (SELECT regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS key, s_suppkey % 2 = 0 AS even, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS sort_order FROM supplier)
SELECT key, sort_order FROM p UNION ALL SELECT key || 'upper', sort_order FROM p WHERE even""",
    "word_table_labels": "SELECT unnest(['key' || s_suppkey || 'jo', 'key' || s_suppkey]) AS key, s_suppkey || ' Neck Rd, Old Town' AS billing_address FROM supplier",
    "label_lookup": """SELECT CASE s_suppkey % 3 WHEN 0 THEN 'Key' || s_suppkey || ', JO' WHEN 1 THEN 'KEY' || s_suppkey || ', Al' ELSE 'KEY' || s_suppkey || ' Al' END AS name, CASE WHEN s_suppkey % 3 < 2 THEN s_suppkey || ' Neck Rd, Old Town' END AS "to" FROM supplier""",
    "settled_log": with_tables(
        """SELECT id, client_id, month, description, source_job_id, position FROM numbered""",
        f"""lines AS ({_LINE.format('s1', 0)} UNION ALL {_LINE.format('s1', 900)} WHERE source_job_id IS NOT NULL AND client_id % 5 = 0
 UNION ALL {_LINE.format('s2', 40)} WHERE source_job_id IS NOT NULL AND client_id % 7 = 0 UNION ALL {_LINE.format('s1', 900)} WHERE source_job_id IS NULL)""",
        "last AS (SELECT month, source_job_id, arg_max(send, newest) AS send FROM (SELECT month, source_job_id, send, {'a': max(arrived), 's': send} AS newest FROM lines WHERE source_job_id IS NOT NULL GROUP BY month, source_job_id, send) x GROUP BY month, source_job_id)",
        """alive AS (SELECT given, position, client_id, month, description, source_job_id, send, max(arrived) AS arrived FROM lines l WHERE source_job_id IS NULL OR EXISTS (SELECT 1 FROM last x WHERE x.month = l.month AND x.source_job_id = l.source_job_id AND x.send = l.send)
 GROUP BY given, position, client_id, month, description, source_job_id, send)""",
        "named AS (SELECT *, given IS NOT NULL AND row_number() OVER (PARTITION BY given ORDER BY arrived, month, source_job_id NULLS FIRST, send, position) = 1 AS keeps FROM alive)",
        """numbered AS (SELECT *, CASE WHEN keeps THEN given ELSE (SELECT coalesce(max(given), 0) FROM named WHERE keeps) + row_number() OVER (PARTITION BY keeps ORDER BY arrived, month, source_job_id NULLS FIRST, send, position) END AS id FROM named)""",
    ),
}
