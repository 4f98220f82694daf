"""Queries and oracles: sheets, marks, linkage, office lists, chat questions, scores."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.jsonfix import repaired
from ..functions.marks import boxes, with_marks
from ..operators import commit as C
from ..operators import linkage as L
from ..operators import merge as M
from ..operators import score as R
from ..operators import sheets as S
from ..operators import views as V
from ..sources import office as O
from ..sources.fixtures import Ledger, with_tables
from . import intent as I
from . import likeness_sql as Q

TODAY = date(2026, 11, 1)


def _parsed(led: Ledger):
    return S.parse(led.jobs)


def cells(led: Ledger):
    """Work cells made of known parts: two visit days, a hedge day and a priced job."""
    k = F.col("l_quantity").cast("int")
    day = lambda n: (n % 28 + 1).cast("string")
    cell = F.concat(day(k), F.lit("/"), day(k + 5), F.lit(" "), day(k + 9), F.lit(" h | dump run $"), (k + 40).cast("string"))
    return led.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", cell.alias("cell"))


_LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]


def sheet_names(led: Ledger):
    """Names as a sheet might spell them: roster names with a doubled letter, a dropped one, other order."""
    n, i = F.col("name"), F.col("id")
    spelled = F.when(i % 4 == 0, F.lower(n)).when(i % 4 == 1, F.regexp_replace(n, "^(.)(.)", "$1$2$2")).when(i % 4 == 2, F.regexp_replace(n, "^(...).", "$1")).otherwise(F.concat_ws(" ", T.after_comma(n), F.split_part(n, F.lit(","), F.lit(1))))
    return led.clients.select("id", spelled.alias("sheet_name"))


def like_pairs(led: Ledger):
    """Spelled names with their own client's name, that of the client of half the id and that of the next of the same surname."""
    own = led.clients.select("id", "name")
    spelled = sheet_names(led).select("id", F.col("sheet_name").alias("l"))
    pairs = [spelled.join(own.select(at.alias("id"), F.col("name").alias("r")), "id") for at in (F.col("id"), F.col("id") * 2, F.col("id") - 13)]
    return pairs[0].union(pairs[1]).union(pairs[2]).select("l", "r").distinct()


def noted_names(led: Ledger):
    """Sheet rows for the conflicts: every spelled name, and names of no client."""
    n = sheet_names(led).select("sheet_name").union(led.table("supplier").select(F.col("s_name")))
    return n.select(F.col("sheet_name").alias("seq"), F.col("sheet_name").alias("name"), F.lit("15h").alias("work"))


def questions(led: Ledger):
    """Chat questions made of orders: a verb, a month as name, number or words."""
    verb = F.element_at(F.array(*map(F.lit, ("do I have any", "Delete", "show me", "how many bills in", "wipe all"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    at = F.lower(F.date_format("o_orderdate", "MMM"))
    when = F.when(F.col("o_orderkey") % 3 == 0, F.concat(at, F.lit(" data"))).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "'work in '2'0'yy-MM".replace("2'0'", "'20'"))).otherwise("this month")
    return led.table("orders").select("o_orderkey", F.concat_ws(" ", verb, when).alias("question"))


def office_lines(led: Ledger):
    """A list in lines for each nation: headers, then name, price, address and note lines of its suppliers."""
    lines = F.array(F.concat(F.lit("KEY"), F.lit(", "), F.col("s_name")), F.concat(F.lit("$"), (F.col("s_suppkey") % 90 + 10).cast("string")), F.concat(F.col("s_suppkey").cast("string"), F.lit(" Neck Rd")), F.lit("call first"))
    rows = led.table("supplier").select(F.col("s_nationkey").cast("long").alias("doc"), "s_suppkey", F.posexplode(lines).alias("p", "line"))
    head = led.table("nation").select(F.col("n_nationkey").cast("long").alias("doc"), F.lit(-1).cast("long").alias("line_no"), F.lit("Notes").alias("line"))
    return rows.select("doc", (F.col("s_suppkey") * 10 + F.col("p")).alias("line_no"), "line").union(head)


def records(led: Ledger):
    """Three office lists of one roster: prices, hedges, phones; names differ in form."""
    base = led.clients
    one = base.select(F.lit(0).alias("source"), F.col("id").alias("seq"), "name", "address", "mow_price", F.lit(None).cast("decimal(12,2)").alias("hedge_price"), F.lit(None).cast("string").alias("phone"), "billing_notes")
    two = base.filter("id % 2 = 0").select(F.lit(1).alias("source"), F.col("id").alias("seq"), F.upper("name").alias("name"), F.lit("x").alias("address"), F.lit(None).cast("decimal(12,2)").alias("mow_price"), "hedge_price", F.lit(None).cast("string").alias("phone"), F.lit("trim low").alias("billing_notes"))
    three = base.filter("id % 3 = 0").select(F.lit(2).alias("source"), F.col("id").alias("seq"), F.concat("name", F.lit(".")).alias("name"), F.lit(None).cast("string").alias("address"), F.lit(1).cast("decimal(12,2)").alias("mow_price"), F.lit(7).cast("decimal(12,2)").alias("hedge_price"), "phone", F.lit("trim").alias("billing_notes"))
    return one.unionByName(two).unionByName(three)


def scored(led: Ledger):
    """Checked and read rows of sheets of 20 lines: read ones miss every seventh and shift some prices and days."""
    base = led.table("orders").select(F.floor(F.col("o_orderkey") / 20).cast("string").alias("sheet"), (F.col("o_orderkey") % 20).alias("seq"), F.concat(F.lit("CLIENTELE NUMBER"), F.col("o_orderkey").cast("string")).alias("name"), F.round("o_totalprice", 2).alias("price"), F.array(F.dayofmonth("o_orderdate")).alias("days"), "o_orderkey")
    read = base.filter("o_orderkey % 7 <> 0").withColumns({"price": F.col("price") + F.when(F.col("o_orderkey") % 5 == 0, 2.0).otherwise(1.0), "days": F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit(99))).otherwise(F.col("days"))})
    return base.drop("o_orderkey"), read.drop("o_orderkey")


#: Clients that the stored sheets name.
MADE = [(10**9 + k, f"SMITH, Mary {k}", 40.0, 25.0) for k in range(9)] + [(10**9 + 9, "BRADY, Jim", 31.0, 55.5)]
MONTH = "1996-03"


def sheet_jobs(led: Ledger, upto: int):
    """Stored sheets; the first ones are of a month that has work from jobs of their names."""
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    jobs = led.jobs.withColumn("month", F.when(n < upto, MONTH).otherwise(F.col("month")))
    return jobs.filter("status = 'stored' AND month LIKE '____-__' AND extract_json IS NOT NULL")


def named_clients(led: Ledger):
    """The roster and the clients that the sheets name."""
    made = led.spark.createDataFrame(MADE, "id long, name string, mow_price double, hedge_price double")
    return led.clients.unionByName(made.withColumns({c: F.col(c).cast("decimal(12,2)") for c in ("mow_price", "hedge_price")}), allowMissingColumns=True)


def confirmed(led: Ledger):
    """All stored sheets filed in one go over the whole roster and ledger."""
    return C.confirm(sheet_jobs(led, 40).select("id", "month", "extract_json"), named_clients(led), led.work)


def cut_off(led: Ledger):
    """Stored sheets that break off in their last row, their notes or behind them, and their repair."""
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("int")
    text = F.expr("substr(extract_json, 1, length(extract_json) - 1 - cut)")
    return led.dealt_jobs.filter("extract_json IS NOT NULL").withColumn("cut", n % 60).select("id", repaired(text).alias("fixed"))


QUERIES = {
    "extract_rows": lambda s, d: S.extract_rows(_parsed(Ledger(s, d))).select("id", "row_no", "name", "price", "work"),
    "extract_has_rows": lambda s, d: _parsed(Ledger(s, d)).select("id", S.has_rows(F.col("sheet")).alias("has_rows")),
    "fill_stats": lambda s, d: S.fill_stats(_parsed(Ledger(s, d))),
    "dedupe_richest": lambda s, d: S.richest_rows(S.extract_rows(_parsed(Ledger(s, d))), ["id"]).select("id", F.array_join("cells", "|").alias("cells"), "seen"),
    "collapse_longest": lambda s, d: S.longest_rows(S.extract_rows(_parsed(Ledger(s, d))), ["id"]),
    "merge_photos": lambda s, d: S.merge_photos(_parsed(Ledger(s, d)).filter("extract_json IS NOT NULL").withColumn("photo_no", F.col("created_at")), "user_id").select("user_id", "title", F.size("tables").alias("tables"), F.size("notes").alias("notes")),
    "pick_editable_job": lambda s, d: S.pick_editable(_parsed(Ledger(s, d))).select("id", "month", "status"),
    "work_marks": lambda s, d: with_marks(cells(Ledger(s, d)), "cell", "found").select(*_LINE_KEY, F.posexplode_outer("found").alias("pos", "m")).filter("m IS NOT NULL").select(*_LINE_KEY, "pos", "m.kind", "m.day", "m.name", "m.amount"),
    "review_boxes": lambda s, d: with_marks(cells(Ledger(s, d)), "cell", "found").select(*_LINE_KEY, F.array_join(boxes(F.col("found")), ";").alias("boxes")),
    "confirm_lines": lambda s, d: confirmed(Ledger(s, d))["work"].select("client_id", "month", "day_or_note", "description", "amount", "source_job_id"),
    "name_similarity": lambda s, d: like_pairs(Ledger(s, d)).withColumn("score", L.name_similarity("l", "r")),
    "filing_exact": lambda s, d: L.file_clients((x := Ledger(s, d)).clients.filter("mow_price IS NOT NULL").select(F.upper("name").alias("sheet_name")), x.clients),
    "filing_clients": lambda s, d: L.file_clients(sheet_names(x := Ledger(s, d)), x.clients),
    "suggest_clients": lambda s, d: L.suggest_clients(sheet_names(x := Ledger(s, d)), x.clients),
    "open_conflicts": lambda s, d: L.open_conflicts(noted_names(x := Ledger(s, d)), x.clients),
    "retarget_moves": lambda s, d: L.retarget_month((x := Ledger(s, d)).work, x.clients, MONTH),
    "merge_office_lists": lambda s, d: M.merge_sources(records(Ledger(s, d))),
    "match_office_roster": lambda s, d: M.match_roster(records(x := Ledger(s, d)).filter("source = 0").select(F.when(F.col("seq") % 2 == 0, T.name_key(F.col("name"))).otherwise(F.concat(T.name_key(F.col("name")), F.lit("etal"))).alias("key"), "seq"), x.clients),
    "hedge_list": lambda s, d: O.hedge_records(office_lines(Ledger(s, d))).select("doc", "record", "name", "address", "hedge_price", "billing_notes"),
    "lawn_groups": lambda s, d: O.groups(Ledger(s, d).table("supplier").select(F.col("s_nationkey").alias("doc"), F.col("s_suppkey").alias("seq"), F.col("s_name").alias("name")), 3),
    "chat_months": lambda s, d: questions(Ledger(s, d)).select("o_orderkey", I.status_month(F.col("question"), F.lit(TODAY)).alias("status"), I.wipe_month(F.col("question"), F.lit(TODAY)).alias("wipe")),
    "inventory_replies": lambda s, d: V.month_counts(Ledger(s, d).work).select("month", I.reply(F.col("month"), F.col("n"), F.col("n") % 3, F.lit(1).cast("long"), F.col("n") % 2).alias("reply")),
    "recall_counts": lambda s, d: R.recall(*scored(Ledger(s, d))),
    "recall_weighted": lambda s, d: R.weighted(R.recall(*scored(Ledger(s, d)))),
    "attachment_batches": lambda s, d: R.batches(Ledger(s, d).work.select("month", "id", F.coalesce(F.col("amount").cast("long"), F.lit(0)).alias("bytes")), 500_000, "month", "id", "bytes"),
    "name_chunks": lambda s, d: R.chunks(Ledger(s, d).work.select("month", "id"), 4, "id", "month"),
    "json_repair": lambda s, d: cut_off(Ledger(s, d)).select("id", F.get_json_object("fixed", "$.title").alias("title"), F.get_json_object("fixed", "$.tables[0].rows[0][0]").alias("first")),
}

_Q = """q AS (SELECT o_orderkey, lower(v[o_orderkey % 5 + 1] || ' ' || CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%b') || ' data' WHEN 1 THEN 'work in 20' || strftime(o_orderdate, '%y-%m') ELSE 'this month' END) AS t,
  CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN month(o_orderdate) <= 11 THEN '2026-' ELSE '2025-' END || lpad(month(o_orderdate)::VARCHAR, 2, '0') WHEN 1 THEN '20' || strftime(o_orderdate, '%y-%m') ELSE '2026-10' END AS m
  FROM (SELECT *, ['do i have any', 'delete', 'show me', 'how many bills in', 'wipe all'] AS v FROM orders) o)"""
_KEYS = ", ".join(_LINE_KEY)
_DAYS = "l_quantity::INT AS k"
_JOB = "(SELECT event_id, id, user_id, extract_json IS NOT NULL AS has, event_id % 7 > 1 AS real FROM (SELECT j.*, e.event_id FROM jobs j JOIN events e ON j.id = 'job-' || e.event_id) x)"
_ROWS = f"""rws AS (SELECT id, 0::INT AS row_no, 'SMITH, Mary ' || event_id % 9 AS name, (event_id % 70)::DOUBLE AS price, (event_id % 28 + 1) || ' 30' AS work, event_id FROM {_JOB} WHERE real
 UNION ALL SELECT id, 2, 'BRADY, Jim', (1000 + event_id % 900)::DOUBLE + 0.5, '1,' || lpad((event_id % 900)::VARCHAR, 3, '0') || '.50', event_id FROM {_JOB} WHERE real
 UNION ALL SELECT id, 4, 'BRADY, Jim', NULL, (event_id % 28 + 1) || 'h', event_id FROM {_JOB} WHERE real)"""
_RECALL = """SELECT (o_orderkey // 20)::VARCHAR AS sheet, count(*) AS n_gold, count(*) AS n_price, count(*) AS n_days, count(*) FILTER (o_orderkey % 7 <> 0) AS n_read, count(*) FILTER (o_orderkey % 7 <> 0) AS clients,
  count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0) AS prices, count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0) AS day_hits FROM orders GROUP BY 1"""


def sql_sheets(upto: int) -> tuple[str, str]:
    """Steps sent (stored sheets, as sheet_jobs) and sheet_lines (their priced lines)."""
    sent = f"sent AS (SELECT * FROM (SELECT x.id, event_id, real, CASE WHEN event_id < {upto} THEN '{MONTH}' ELSE j.month END AS m FROM {_JOB} x JOIN jobs j ON j.id = x.id WHERE j.status = 'stored' AND has) t WHERE m LIKE '____-__')"
    rows = f"""sheet_lines AS (SELECT id, m, {10**9} + event_id % 9 AS client_id, v.day::VARCHAR AS note, 'Mowing ' || v.day AS description, 40::DECIMAL(12,2) AS amount FROM sent, LATERAL (SELECT unnest([event_id % 28 + 1, 30]) AS day) v WHERE real
 UNION ALL SELECT id, m, {10**9 + 9}, '1', 'Mowing 1', 31 FROM sent WHERE real UNION ALL SELECT id, m, {10**9 + 9}, (event_id % 28 + 1) || 'h', 'Hedging ' || (event_id % 28 + 1), 55.5 FROM sent WHERE real)"""
    return sent, rows


_RECURSIVE = lambda sql, *steps: with_tables(sql, *steps).replace("WITH ", "WITH RECURSIVE ", 1)
_LIKE_PAIRS = """like_pairs AS (SELECT DISTINCT sheet_name AS l, name AS r FROM sheet_names s JOIN clients c ON c.id = s.id OR c.id * 2 = s.id OR c.id - 13 = s.id)"""

ORACLES = {
    "name_similarity": _RECURSIVE("SELECT l, r, score FROM likeness", Q.SHEET_NAMES, _LIKE_PAIRS, "l_names AS (SELECT l AS name FROM like_pairs)", "r_names AS (SELECT r AS name FROM like_pairs)", Q.forms("left_forms", "l_names"), Q.forms("right_forms", "r_names"), *Q.scores("like_pairs")),
    "filing_clients": _RECURSIVE("SELECT sheet_name, client_id FROM filed", Q.SHEET_NAMES, *Q.filing("sheet_names")),
    "open_conflicts": _RECURSIVE("SELECT * FROM conflicts", Q.SHEET_NAMES, "noted AS (SELECT sheet_name AS seq, sheet_name, '15h' AS work FROM (SELECT sheet_name FROM sheet_names UNION ALL SELECT s_name FROM supplier) n)", *Q.conflicts("noted")),
    "retarget_moves": _RECURSIVE(f"SELECT '{MONTH}' AS month, id AS source, client_id AS target FROM moving JOIN filed USING (sheet_name) WHERE client_id <> id",
        f"moving AS (SELECT id, name AS sheet_name FROM clients WHERE id IN (SELECT client_id FROM work_items WHERE month = '{MONTH}'))", "listed AS (SELECT * FROM clients WHERE coalesce(on_roster, true))", *Q.filing("moving", "listed")),
    "suggest_clients": _RECURSIVE("SELECT sheet_name, suggestion, suggestion_name FROM suggested", Q.SHEET_NAMES, *Q.suggestions("sheet_names")),
    "extract_rows": with_tables("SELECT id, row_no, name, price, work FROM rws", _ROWS),
    "extract_has_rows": with_tables(f"SELECT id, real AS has_rows FROM {_JOB}"),
    "fill_stats": with_tables(f"SELECT id, CASE WHEN real THEN 10 ELSE 0 END::INT AS filled, CASE WHEN real THEN 13 ELSE 0 END::INT AS total, CASE WHEN real THEN 4 ELSE 0 END::INT AS rows, CASE WHEN real THEN 9 / 12.0 ELSE 0.0 END::DOUBLE AS fill_rate, CASE WHEN real THEN 3 ELSE 0 END::INT AS max_cols, CASE WHEN real THEN 1 ELSE 0 END::INT AS n_tables FROM {_JOB}"),
    "dedupe_richest": with_tables(
        f"""SELECT id, CASE WHEN seen = 0 THEN 'SMITH, Mary ' || event_id % 9 || '|' || (event_id % 28 + 1) || ' 30|$' || event_id % 70 ELSE 'BRADY, Jim||1,' || lpad((event_id % 900)::VARCHAR, 3, '0') || '.50' END AS cells, seen FROM {_JOB}, (VALUES (0::INT), (2::INT)) v(seen) WHERE real"""
    ),
    "collapse_longest": with_tables("SELECT id, name, arg_max(work, row_no = 2) AS work, min(row_no) AS seen FROM rws GROUP BY id, name", _ROWS),
    "merge_photos": with_tables(f"SELECT user_id, max(CASE WHEN real THEN 't' END) AS title, count(*) FILTER (real)::INT AS tables, (2 * count(*) FILTER (real))::INT AS notes FROM {_JOB} WHERE has GROUP BY user_id"),
    "pick_editable_job": with_tables(f"SELECT j.id, j.month, j.status FROM jobs j JOIN {_JOB} x ON x.id = j.id WHERE j.status IN ('done', 'stored') AND x.real ORDER BY j.updated_at DESC NULLS LAST, j.id LIMIT 1"),
    "work_marks": f"""WITH c AS (SELECT {_KEYS}, {_DAYS} FROM lineitem)
SELECT {_KEYS}, p::INT AS pos, CASE p WHEN 2 THEN 'hedge' WHEN 3 THEN 'note' WHEN 4 THEN 'custom' ELSE 'mow' END AS kind, CASE p WHEN 0 THEN k % 28 + 1 WHEN 1 THEN (k + 5) % 28 + 1 WHEN 2 THEN (k + 9) % 28 + 1 END::INT AS day,
  CASE p WHEN 3 THEN (k % 28 + 1) || ' ' || ((k + 5) % 28 + 1) || ' ' || ((k + 9) % 28 + 1) || 'h' WHEN 4 THEN 'dump run' ELSE '' END AS name, CASE WHEN p = 4 THEN (k + 40)::DOUBLE END AS amount
FROM c, (VALUES (0), (1), (2), (3), (4)) v(p)""",
    "review_boxes": f"SELECT {_KEYS}, (k % 28 + 1) || ';' || ((k + 5) % 28 + 1) || ';' || ((k + 9) % 28 + 1) || 'h;' || (k % 28 + 1) || ' ' || ((k + 5) % 28 + 1) || ' ' || ((k + 9) % 28 + 1) || 'h;dump run $' || (k + 40) AS boxes FROM (SELECT {_KEYS}, {_DAYS} FROM lineitem) c",
    "filing_exact": with_tables("SELECT upper(name) AS sheet_name, id AS client_id FROM clients WHERE mow_price IS NOT NULL"),
    "merge_office_lists": with_tables(
        """SELECT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key, CASE WHEN id % 3 = 0 THEN name || '.' ELSE name END AS name, coalesce(nullif(address, ''), CASE WHEN id % 2 = 0 THEN 'x' END) AS address,
  coalesce(mow_price, CASE WHEN id % 3 = 0 THEN 1 END)::DECIMAL(12,2) AS mow_price, coalesce(CASE WHEN id % 2 = 0 THEN hedge_price END, CASE WHEN id % 3 = 0 THEN 7 END)::DECIMAL(12,2) AS hedge_price, CASE WHEN id % 3 = 0 THEN phone END AS phone,
  CASE WHEN id % 2 = 0 THEN concat_ws(' | ', billing_notes, 'trim low') WHEN id % 3 = 0 THEN concat_ws(' | ', billing_notes, 'trim') ELSE billing_notes END AS billing_notes FROM clients"""
    ),
    "match_office_roster": with_tables("SELECT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') || CASE WHEN id % 2 = 0 THEN '' ELSE 'etal' END AS key, id FROM clients"),
    "hedge_list": "SELECT s_nationkey::BIGINT AS doc, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS record, 'KEY, ' || s_name AS name, s_suppkey || ' Neck Rd' AS address, (s_suppkey % 90 + 10)::DECIMAL(12,2) AS hedge_price, 'call first' AS billing_notes FROM supplier",
    "lawn_groups": "SELECT regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS key, 'group-' || ((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) // 3 + 1) AS mowing_group FROM supplier",
    "chat_months": f"WITH {_Q} SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 3) THEN m END AS status, CASE WHEN o_orderkey % 5 IN (1, 4) THEN m END AS wipe FROM q",
    "inventory_replies": with_tables(
        """SELECT month, concat_ws(' ', month || ' has ' || n || CASE WHEN n = 1 THEN ' stored work line' ELSE ' stored work lines' END || ' and ' || n % 3 || CASE WHEN n % 3 = 1 THEN ' generated bill.' ELSE ' generated bills.' END,
  CASE WHEN n % 2 = 1 THEN 'There is also 1 OCR sheet for ' || month || ' still on the review/upload list (not the same as sent work).' END) AS reply FROM (SELECT month, count(*) AS n FROM work_items GROUP BY month) x"""
    ),
    "recall_counts": _RECALL,
    "name_chunks": with_tables("SELECT month, id, ((row_number() OVER (PARTITION BY month ORDER BY id) - 1) // 4)::INT AS chunk FROM work_items"),
    "json_repair": with_tables(f"SELECT id, CASE WHEN real THEN 't' END AS title, CASE WHEN real THEN 'SMITH, Mary ' || event_id % 9 END AS first FROM {_JOB} WHERE has"),
    "confirm_lines": with_tables(f"""SELECT client_id, month, day_or_note, description, amount, source_job_id FROM work_items w WHERE NOT EXISTS (SELECT 1 FROM sent WHERE sent.id = w.source_job_id AND sent.m = w.month)
UNION ALL SELECT client_id, m, note, description, amount, id FROM sheet_lines""", *sql_sheets(40)),
    "recall_weighted": f"""SELECT round(sum(clients) / sum(n_gold), 4) AS client_recall, round(sum(prices) / sum(n_price), 4) AS price_recall, round(sum(day_hits) / sum(n_days), 4) AS day_recall, round(avg(round(clients / n_gold, 4)), 4) AS mean_client_recall FROM ({_RECALL}) c""",
    "attachment_batches": with_tables("""SELECT month, id, bytes, batch FROM filled""",
        "sized AS (SELECT month, id, coalesce(amount::BIGINT, 0) AS bytes, row_number() OVER (PARTITION BY month ORDER BY id) AS rn FROM (SELECT month, id, trunc(amount) AS amount FROM work_items) w)",
        """filled AS (SELECT month, id, bytes, rn, 0 AS batch, bytes AS held FROM sized WHERE rn = 1
 UNION ALL SELECT s.month, s.id, s.bytes, s.rn, CASE WHEN held > 0 AND held + s.bytes > 500000 THEN batch + 1 ELSE batch END, CASE WHEN held > 0 AND held + s.bytes > 500000 THEN s.bytes ELSE held + s.bytes END
  FROM filled f JOIN sized s ON s.month = f.month AND s.rn = f.rn + 1)""").replace("WITH ", "WITH RECURSIVE ", 1),
}
