"""Queries and oracles: invoices, tax, repricing, the bill editor."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import invoice as I
from ..operators import views as V
from ..sources import sinks
from ..sources.fixtures import Ledger, with_tables
from .reads import sql_strip


def lines(led: Ledger):
    """Work lines with their client's prices."""
    priced = led.clients.select(F.col("id").alias("__c"), "mow_price", "hedge_price")
    return led.work.join(priced, F.col("client_id") == F.col("__c")).drop("__c")


def edited(led: Ledger):
    """Bill editor input: two or three dates of orders in one cell."""
    m = F.col("month")
    day = F.dayofmonth("created_at")
    n = F.col("id")
    date = F.when(n % 5 == 0, "").when(n % 5 == 1, F.concat(day.cast("string"), F.lit(", 9/14; 21h"))).when(n % 5 == 2, F.concat(day.cast("string"), F.lit("h"))).otherwise(F.concat(F.lit("3, "), day.cast("string"), F.lit(", x")))
    kind = F.when(n % 7 == 0, "prior").when(n % 7 == 1, "prior_taxed").when(n % 7 == 2, "discount").otherwise("visit")
    return led.work.select(F.col("id").alias("line_id"), m.alias("month"), "description", "amount", date.alias("date"), kind.alias("kind"), F.when(n % 2 == 0, "2001-02").otherwise("").alias("prior_month"))


QUERIES = {
    "tax_figures": lambda s, d: I.tax_figures(Ledger(s, d).work),
    "tax_totals": lambda s, d: I.tax_totals(I.tax_figures(Ledger(s, d).work)),
    "tax_tsv": lambda s, d: sinks.tsv_lines(V.work_for_month((x := Ledger(s, d)).work, x.clients)),
    "line_role_decode": lambda s, d: I.decode(Ledger(s, d).work).select("id", "role", "label", "day", "prior_month", "prior_day"),
    "invoice_compile": lambda s, d: I.compile_rows(lines(Ledger(s, d))),
    "invoice_editable": lambda s, d: I.editable_lines(I.compile_rows(lines(Ledger(s, d)))),
    "reprice_visits": lambda s, d: I.reprice_visits(lines(Ledger(s, d))).select("id", "month", "client_id", "description", "amount"),
    "split_amount": lambda s, d: Ledger(s, d).table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.posexplode(T.split_amount(F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_linenumber"))).alias("piece", "amount")),
    "editor_dates": lambda s, d: (x := edited(Ledger(s, d))).select("line_id", F.posexplode(T.editor_dates(F.col("date"), F.col("month"))).alias("n", "e")).select("line_id", "n", "e.month", "e.day", "e.hedge"),
    "editor_items": lambda s, d: I.editor_items(edited(Ledger(s, d))),
    "lineitem_tax": lambda s, d: Ledger(s, d).table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.round(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)")), 2)).cast("decimal(18,2)").alias("revenue"), F.sum(F.round(F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_tax").cast("decimal(4,2)"), 2)).cast("decimal(18,2)").alias("tax")),
}

_desc, _note = sql_strip("description"), sql_strip("day_or_note")
_MOW, _HEDGE, _PRIOR = r"(?i)^mow(?:ing)?(?:\s+(\d{1,2}))?$", r"(?i)^hedg(?:e|ing)(?:\s+(\d{1,2}))?$", r"(?i)^prior(-taxed)?:(\d{4}-\d{2})(?::(\d{1,2}))?$"
DECODED = f"""decoded AS (SELECT *, CASE WHEN lower(note) = 'discount' OR starts_with(lower(dsc), 'discount') THEN 'discount'
    WHEN regexp_matches(note, '{_PRIOR}') THEN CASE WHEN regexp_extract(note, '{_PRIOR}', 1) <> '' THEN 'prior_taxed' ELSE 'prior' END ELSE 'visit' END AS role,
  CASE WHEN regexp_matches(dsc, '{_MOW}') THEN 'Mowing' WHEN regexp_matches(dsc, '{_HEDGE}') THEN 'Hedging' ELSE dsc END AS label,
  coalesce(try_cast(nullif(regexp_extract(note, '(?i)^(\\d{{1,2}})h?$', 1), '') AS INT), try_cast(nullif(regexp_extract(dsc, '{_MOW}', 1), '') AS INT), try_cast(nullif(regexp_extract(dsc, '{_HEDGE}', 1), '') AS INT)) AS day,
  CASE WHEN lower(note) = 'discount' OR starts_with(lower(dsc), 'discount') THEN '' ELSE regexp_extract(note, '{_PRIOR}', 2) END AS prior_month,
  CASE WHEN lower(note) = 'discount' OR starts_with(lower(dsc), 'discount') THEN '' ELSE regexp_extract(note, '{_PRIOR}', 3) END AS prior_day
 FROM (SELECT *, {_desc} AS dsc, {_note} AS note FROM work_items) w)"""
_SHOWN = "label <> '' AND lower(label) NOT IN ('sales tax', 'total')"
_NAMES = "['January','February','March','April','May','June','July','August','September','October','November','December']"
_FIGURES = f"""figures AS (SELECT month, client_id, revenue, prior, prior_taxed, round((revenue + prior) * 0.0635, 2)::DECIMAL(18,2) AS tax,
  (revenue + prior + round((revenue + prior) * 0.0635, 2) + prior_taxed)::DECIMAL(18,2) AS total, concat_ws('; ', due || ' — taxed with this month', done || ' — tax already included') AS note FROM (
 SELECT month, client_id, sum(CASE role WHEN 'discount' THEN -abs(a) WHEN 'visit' THEN a ELSE 0 END)::DECIMAL(18,2) AS revenue, sum(CASE WHEN role = 'prior' THEN a ELSE 0 END)::DECIMAL(18,2) AS prior,
  sum(CASE WHEN role = 'prior_taxed' THEN a ELSE 0 END)::DECIMAL(18,2) AS prior_taxed, string_agg(CASE WHEN role = 'prior' THEN lab END, ', ' ORDER BY id) AS due, string_agg(CASE WHEN role = 'prior_taxed' THEN lab END, ', ' ORDER BY id) AS done
 FROM (SELECT *, coalesce(amount, 0) AS a, CASE WHEN prior_month <> '' THEN {_NAMES}[substr(prior_month, 6)::INT] || ' ' || substr(prior_month, 1, 4) END AS lab FROM decoded WHERE {_SHOWN}) x GROUP BY month, client_id) y)"""

_COMPILE = [
    DECODED,
    """loose AS (SELECT *, CASE WHEN role = 'visit' AND label NOT IN ('Mowing', 'Hedging') AND regexp_matches(note, '^\\d{1,2}/\\d{1,2}$') THEN substr(month, 1, 4) || '-' || lpad(split_part(note, '/', 1), 2, '0') END AS lm,
  CASE WHEN role = 'visit' AND label NOT IN ('Mowing', 'Hedging') AND regexp_matches(note, '^\\d{1,2}/\\d{1,2}$') THEN split_part(note, '/', 2)::INT END AS ld FROM decoded)""",
    f"""lines AS (SELECT l.id, l.month, l.client_id, label, coalesce(l.amount, 0)::DECIMAL(18,2) AS amount,
  CASE WHEN lm <> l.month THEN 'prior' ELSE role END AS role, CASE WHEN lm <> l.month THEN lm ELSE prior_month END AS pm, CASE WHEN lm <> l.month THEN ld::VARCHAR ELSE prior_day END AS pd,
  CASE WHEN lm = l.month THEN ld ELSE day END AS day, CASE label WHEN 'Mowing' THEN c.mow_price WHEN 'Hedging' THEN c.hedge_price END AS unit
  FROM loose l JOIN clients c ON c.id = l.client_id WHERE {_SHOWN})""",
    """kinds AS (SELECT *, CASE WHEN role IN ('prior', 'prior_taxed') AND pd <> '' THEN CASE WHEN label IN ('Mowing', 'Hedging') THEN 'b' ELSE 's' END ELSE 'g' END AS k FROM lines)""",
    """body AS (SELECT month, client_id, k, role, min(id) AS seq, arg_min(label, id) AS label, arg_max(unit, CASE WHEN unit IS NOT NULL THEN id END) AS unit,
  sum(CASE WHEN k = 'g' AND amount = 0 AND unit IS NOT NULL THEN unit ELSE amount END) AS amount, min(pm) AS pm, min(pd) AS pd,
  list_sort(list_distinct(list(CASE WHEN k <> 'g' THEN pd::INT WHEN role = 'visit' AND day BETWEEN 1 AND 31 THEN day END))) AS days
  FROM (SELECT *, CASE k WHEN 'b' THEN pm || label WHEN 's' THEN id::VARCHAR ELSE lower(label) END AS grp FROM kinds) x GROUP BY month, client_id, k, role, grp)""",
    """shown AS (SELECT month, client_id, CASE k WHEN 'g' THEN 1 WHEN 's' THEN 2 ELSE 3 END + CASE WHEN role = 'prior_taxed' THEN 4 ELSE 0 END AS section, seq,
  CASE WHEN k = 's' THEN substr(pm, 6)::INT || '/' || pd WHEN k = 'b' THEN array_to_string(list_transform(days, lambda x: substr(pm, 6)::INT || '/' || x), ', ')
   WHEN role = 'visit' THEN coalesce(array_to_string(list_transform(days, lambda x: substr(month, 6)::INT || '/' || x), ', '), '') ELSE '' END AS date, label AS description,
  (CASE WHEN role = 'discount' THEN -abs(amount) WHEN k = 'g' AND amount = 0 AND unit IS NOT NULL AND len(days) > 0 THEN unit * len(days) ELSE amount END)::DECIMAL(18,2) AS amount, role AS kind, CASE WHEN k = 'g' THEN '' ELSE pm END AS prior_month FROM body)""",
    """sums AS (SELECT month, client_id, sum(CASE WHEN section < 4 THEN amount ELSE 0 END) AS before, sum(CASE WHEN section > 4 THEN amount ELSE 0 END) AS after FROM shown GROUP BY ALL)""",
    """compiled AS (SELECT * FROM shown UNION ALL SELECT month, client_id, 4, NULL, '', 'Sales tax', round(before * 0.0635, 2)::DECIMAL(18,2), NULL, NULL FROM sums
 UNION ALL SELECT month, client_id, 8, NULL, '', 'Total', (before + round(before * 0.0635, 2) + after)::DECIMAL(18,2), NULL, NULL FROM sums)""",
]
_EDITED = """edited AS (SELECT id AS line_id, month, trim(description) AS dsc, coalesce(amount, 0)::DECIMAL(18,2) AS amount,
  CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN day(created_at) || ', 9/14; 21h' WHEN 2 THEN day(created_at) || 'h' ELSE '3, ' || day(created_at) || ', x' END AS date,
  CASE id % 7 WHEN 0 THEN 'prior' WHEN 1 THEN 'prior_taxed' WHEN 2 THEN 'discount' ELSE 'visit' END AS kind, CASE WHEN id % 2 = 0 THEN '2001-02' ELSE '' END AS pm, day(created_at) AS d FROM work_items)"""
_CELLS = """cells AS (SELECT line_id, month, unnest(CASE line_id % 5 WHEN 0 THEN [] WHEN 1 THEN [{'m': month, 'd': d, 'h': false}, {'m': substr(month, 1, 4) || '-09', 'd': 14, 'h': false}, {'m': month, 'd': 21, 'h': true}]
   WHEN 2 THEN [{'m': month, 'd': d, 'h': true}] ELSE [{'m': month, 'd': 3, 'h': false}, {'m': month, 'd': d, 'h': false}] END) AS e, generate_subscripts(CASE line_id % 5 WHEN 0 THEN [] WHEN 1 THEN [1, 2, 3] WHEN 2 THEN [1] ELSE [1, 2] END, 1) AS n FROM edited),
 dates AS (SELECT line_id, (n - 1)::INT AS n, e.m AS month, e.d::INT AS day, e.h AS hedge FROM cells)"""

ORACLES = {
    "tax_figures": with_tables("SELECT * FROM figures", DECODED, _FIGURES),
    "tax_totals": with_tables("SELECT month, count(*) AS clients, " + ", ".join(f"sum({c})::DECIMAL(18,2) AS {c}" for c in ("revenue", "prior", "prior_taxed", "tax", "total")) + " FROM figures GROUP BY month", DECODED, _FIGURES),
    "tax_tsv": with_tables("SELECT w.id, c.name || chr(9) || coalesce(w.description, '') || chr(9) || coalesce(w.amount::VARCHAR, '') || chr(9) || w.month AS line FROM work_items w JOIN clients c ON c.id = w.client_id"),
    "line_role_decode": with_tables("SELECT id, role, label, day, prior_month, prior_day FROM decoded", DECODED),
    "invoice_compile": with_tables("SELECT * FROM compiled", *_COMPILE),
    "invoice_editable": with_tables("SELECT * FROM compiled WHERE description NOT IN ('Sales tax', 'Total')", *_COMPILE),
    "reprice_visits": with_tables(
        """SELECT id, month, client_id, description, (CASE WHEN role = 'visit' AND coalesce(amount, 0) = 0 AND price IS NOT NULL THEN price ELSE amount END)::DECIMAL(12,2) AS amount FROM (
  SELECT x.*, CASE label WHEN 'Mowing' THEN c.mow_price WHEN 'Hedging' THEN c.hedge_price END AS price, row_number() OVER (PARTITION BY month, client_id, CASE WHEN role = 'visit' AND label IN ('Mowing', 'Hedging') AND day IS NOT NULL THEN label || day ELSE '#' || x.id END ORDER BY x.id) AS r
  FROM decoded x JOIN clients c ON c.id = x.client_id) y WHERE r = 1""",
        DECODED,
    ),
    "split_amount": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (i - 1)::INT AS piece, (CASE WHEN i = l_linenumber THEN t - p * (l_linenumber - 1) ELSE p END)::DECIMAL(18,2) AS amount FROM (
  SELECT *, unnest(range(1, l_linenumber + 1)) AS i FROM (SELECT *, l_extendedprice::DECIMAL(18,2) AS t, (((l_extendedprice::DECIMAL(18,2) * 200)::BIGINT // l_linenumber + 1) // 2 / 100.0)::DECIMAL(18,2) AS p FROM lineitem) a) b""",
    "editor_dates": with_tables("SELECT * FROM dates", _EDITED, _CELLS),
    "editor_items": with_tables(
        r"""SELECT e.line_id, coalesce(n, 0)::INT AS piece, e.month, CASE WHEN NOT off AND NOT owed AND d.day IS NOT NULL AND lab IS NOT NULL THEN lab || ' ' || d.day ELSE dsc END AS description,
  (CASE WHEN off OR d.day IS NULL THEN e.amount WHEN n = k - 1 THEN e.amount - p * (k - 1) ELSE p END)::DECIMAL(18,2) AS amount,
  CASE WHEN off THEN 'discount' WHEN owed AND d.day IS NOT NULL THEN base || d.month || ':' || d.day WHEN owed THEN base || pm WHEN d.day IS NULL THEN NULL
   WHEN d.month <> e.month THEN 'prior:' || d.month || ':' || d.day WHEN d.hedge OR contains(lower(dsc), 'hedg') THEN d.day || 'h' ELSE d.day::VARCHAR END AS day_or_note
 FROM (SELECT *, kind = 'discount' OR starts_with(lower(dsc), 'discount') AS off, kind IN ('prior', 'prior_taxed') AS owed, CASE WHEN kind = 'prior_taxed' THEN 'prior-taxed:' ELSE 'prior:' END AS base,
   CASE WHEN regexp_matches(dsc, '(?i)^(mowing|mow( \d{1,2})?$)') THEN 'Mowing' WHEN regexp_matches(dsc, '(?i)^hedging') THEN 'Hedging' END AS lab,
   CASE line_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS k, CASE line_id % 5 WHEN 0 THEN 0 WHEN 1 THEN ((amount * 200)::BIGINT // 3 + 1) // 2 / 100.0 WHEN 2 THEN amount ELSE ((amount * 200)::BIGINT // 2 + 1) // 2 / 100.0 END::DECIMAL(18,2) AS p FROM edited WHERE NOT (dsc = '' AND amount = 0)) e
 LEFT JOIN dates d ON d.line_id = e.line_id AND NOT e.off""",
        _EDITED,
        _CELLS,
    ),
    "lineitem_tax": "SELECT l_returnflag, l_linestatus, sum(round(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)), 2))::DECIMAL(18,2) AS revenue, sum(round(l_extendedprice::DECIMAL(12,2) * l_tax::DECIMAL(4,2), 2))::DECIMAL(18,2) AS tax FROM lineitem GROUP BY ALL",
}
