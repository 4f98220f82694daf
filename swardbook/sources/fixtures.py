"""Ledger relations over the generated star-schema tables.

Each relation is a list of (column, SQL expression); the expressions are plain
enough for Spark and DuckDB alike, so a query and its oracle start from the
same rows and differ in everything after them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SURNAMES = ("SMITH", "BRADY", "KEELER", "OAKES", "TURNER", "VAN DYKE", "LOPEZ", "MARSH", "FENN", "GRAY", "HOLT", "REED", "POND")
_GIVEN = ("Mary", "Jim", "PAT", "Chris", "Lee", "Ana & Joe", "Sam", "Priya", "KELLY", "Tom", "Ruth")


def _pick(values: tuple[str, ...], index: str) -> str:
    arms = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values))
    return f"CASE {index} {arms} END"


_S = "CAST({} AS STRING)"
_ID = _S.format("c_custkey")
CLIENTS = [
    ("id", "c_custkey"),
    ("name", f"{_pick(_SURNAMES, 'c_custkey % 13')} || CASE WHEN c_custkey % 8 = 7 THEN ' ' ELSE ', ' END || {_pick(_GIVEN, 'c_custkey % 11')} || ' ' || CAST(c_custkey + 1000 AS STRING)"),
    ("email", f"CASE c_custkey % 4 WHEN 0 THEN 'c' || {_ID} || '@mail.example' WHEN 1 THEN '' ELSE NULL END"),
    ("phone", "CASE WHEN c_custkey % 3 = 0 THEN '860-555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') ELSE NULL END"),
    ("address", f"CASE WHEN c_custkey % 5 = 1 THEN {_ID} || ' Neck Rd' WHEN c_custkey % 5 = 2 THEN ' ' ELSE NULL END"),
    ("billing_address", "CAST(NULL AS STRING)"),
    ("billing_notes", f"CASE WHEN c_custkey % 5 = 0 THEN 'Send to a' || {_ID} || '@x.org or B' || {_ID} || '@Y.org, $45.50 each' WHEN c_custkey % 5 = 3 THEN 'REGULAR MAIL call (860) 555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') ELSE NULL END"),
    ("mow_price", "CASE WHEN c_custkey % 3 <> 1 THEN CAST(30 + c_custkey % 40 AS DECIMAL(12,2)) ELSE NULL END"),
    ("hedge_price", "CASE WHEN c_custkey % 4 = 2 THEN CAST(50.25 + c_custkey % 30 AS DECIMAL(12,2)) ELSE NULL END"),
    ("hedge_roster", "c_custkey % 6 = 1"),
    ("prefer_mail", "c_custkey % 7 = 0"),
    ("delivery", "CASE WHEN c_custkey % 6 = 0 THEN 'SMS' WHEN c_custkey % 11 = 0 THEN ' email' WHEN c_custkey % 13 = 0 THEN 'mail' WHEN c_custkey % 17 = 0 THEN 'fax' ELSE NULL END"),
    ("entity_kind", "CASE WHEN c_custkey % 50 = 0 THEN 'association' WHEN c_custkey % 20 = 3 THEN 'parcel' ELSE 'client' END"),
    ("sort_order", "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST((c_custkey * 7) % 1000 AS INT) END"),
    ("mowing_group", "CAST(NULL AS STRING)"),
    ("on_roster", "CASE WHEN c_custkey % 10 = 3 THEN false WHEN c_custkey % 10 = 4 THEN NULL ELSE true END"),
]
_DAY = _S.format("day(o_orderdate)")
_MON = "lpad(CAST(month(o_orderdate) AS STRING), 2, '0')"
_MONTH = f"CAST(year(o_orderdate) AS STRING) || '-' || {_MON}"
_LAST = "CASE WHEN month(o_orderdate) = 1 THEN CAST(year(o_orderdate) - 1 AS STRING) || '-12' ELSE CAST(year(o_orderdate) AS STRING) || '-' || lpad(CAST(month(o_orderdate) - 1 AS STRING), 2, '0') END"
_KIND = "CAST(substr(o_orderpriority, 1, 1) AS INT)"
WORK = [
    ("id", "o_orderkey"),
    ("client_id", "o_custkey"),
    ("month", _MONTH),
    (
        "day_or_note",
        f"CASE WHEN o_orderstatus = 'P' THEN 'prior' || CASE WHEN o_orderkey % 2 = 0 THEN '-taxed' ELSE '' END || ':' || {_LAST} || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ':' || {_DAY} END "
        f"WHEN {_KIND} = 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN {_DAY} ELSE NULL END WHEN {_KIND} = 2 THEN {_DAY} || 'h' "
        f"WHEN {_KIND} = 3 THEN CASE o_orderkey % 5 WHEN 0 THEN CAST(month(o_orderdate) AS STRING) || '/' || {_DAY} WHEN 1 THEN CAST(month(o_orderdate) % 12 + 1 AS STRING) || '/' || {_DAY} WHEN 2 THEN '3, 4' ELSE {_DAY} END "
        f"WHEN {_KIND} = 4 THEN {_DAY} ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'discount' ELSE NULL END END",
    ),
    (
        "description",
        f"CASE {_KIND} WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'mowing' ELSE 'mow ' || {_DAY} END WHEN 2 THEN 'hedging' WHEN 3 THEN 'bush trimming' WHEN 4 THEN CASE WHEN o_orderkey % 50 = 0 THEN 'total' ELSE 'dump run' END "
        "ELSE CASE WHEN o_orderkey % 8 = 0 THEN 'discount loyal' WHEN o_orderkey % 31 = 0 THEN '' ELSE 'leaf cleanup' END END",
    ),
    ("amount", f"CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN {_KIND} <= 2 AND o_orderkey % 3 = 0 THEN CAST(0 AS DECIMAL(12,2)) ELSE CAST(o_totalprice AS DECIMAL(12,2)) END"),
    ("source_job_id", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'job-' || CAST(o_orderkey % 40 AS STRING) END"),
]
_ROW = "CAST(event_id {} AS STRING)"
_EXTRACT = (
    "'{\"title\":\"t\",\"tables\":[{\"caption\":\"\",\"columns\":[\"CLIENT\",\"DATE & WORK COMPLETED\",\"Price\"],\"rows\":[[\"SMITH, Mary ' || CAST(event_id % 9 AS STRING) || '\",\"' || CAST(event_id % 28 + 1 AS STRING) || ' 30\",\"$' || CAST(event_id % 70 AS STRING) || '\"],"
    "[\"\",\"\",\"\"],[\"BRADY, Jim\",\"\",\"1,' || lpad(CAST(event_id % 900 AS STRING), 3, '0') || '.50\"],[\"Contact\",\"x\",\"\"],[\"BRADY, Jim\",\"' || CAST(event_id % 28 + 1 AS STRING) || 'h\",\"\"]]}],\"notes\":[\"n\",\"\"],\"complete\":true}'"
)
JOBS = [
    ("id", "'job-' || CAST(event_id AS STRING)"),
    ("status", _pick(("done", "stored", "cleared", "error", "queued"), "event_id % 5")),
    ("progress_msg", "''"),
    ("extract_json", f"CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN '{{\"tables\":[]}}' ELSE {_EXTRACT} END"),
    ("month", "CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 = 1 THEN 'test_month' ELSE CAST(year(ts) AS STRING) || '-' || lpad(CAST(month(ts) AS STRING), 2, '0') END"),
    ("sheet_kind", "'work'"),
    ("user_id", "user_id"),
    ("updated_at", "CASE WHEN event_id % 19 = 0 THEN NULL ELSE ts END"),
    ("created_at", "ts"),
]
BILLS = [
    ("id", "min_id"),
    ("month", "month"),
    ("client_id", "client_id"),
    ("s3_key", "'bills/' || month || '/' || CAST(client_id AS STRING)"),
    ("cover_note", "CASE WHEN min_id % 6 = 0 THEN ' Thanks ' ELSE NULL END"),
    ("display_name", "CASE min_id % 5 WHEN 0 THEN 'Shown ' || CAST(client_id AS STRING) WHEN 1 THEN ' ' ELSE NULL END"),
    ("bill_email", "CASE min_id % 4 WHEN 0 THEN 'bill' || CAST(client_id AS STRING) || '@z.net' WHEN 1 THEN '' ELSE NULL END"),
    ("bill_delivery", "CASE min_id % 7 WHEN 0 THEN 'sms' WHEN 1 THEN 'Email' WHEN 2 THEN 'pigeon' ELSE NULL END"),
    ("emailed_at", "CASE WHEN min_id % 3 = 0 THEN first_at ELSE NULL END"),
]


def _list(columns: list[tuple[str, str]]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns)


_WORK_SQL = f"SELECT {_list(WORK)}, o_orderdate AS created_at FROM orders"
#: The relations as common table expressions for an oracle.
CTE = (
    f"clients AS (SELECT {_list(CLIENTS)} FROM customer), work_items AS ({_WORK_SQL}), jobs AS (SELECT {_list(JOBS)} FROM events), "
    f"bills AS (SELECT {_list(BILLS)} FROM (SELECT month, client_id, min(id) AS min_id, min(created_at) AS first_at FROM work_items WHERE id % 10 < 8 GROUP BY month, client_id) t)"
)


def with_tables(sql: str, *steps: str) -> str:
    return "WITH " + ", ".join([CTE, *steps]) + "\n" + sql


class Ledger:
    """The relations of one data folder; every property is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def clients(self) -> DataFrame:
        return self.table("customer").selectExpr(*(f"{e} AS {c}" for c, e in CLIENTS))

    @property
    def work(self) -> DataFrame:
        return self.table("orders").selectExpr(*(f"{e} AS {c}" for c, e in WORK), "o_orderdate AS created_at")

    @property
    def jobs(self) -> DataFrame:
        return self._jobs(self.table("events"))

    @property
    def dealt_jobs(self) -> DataFrame:
        """The jobs in a set number of parts, for steps that work long on a row: few bytes of events make few tasks."""
        return self._jobs(self.table("events").repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "event_id"))

    def _jobs(self, events: DataFrame) -> DataFrame:
        return events.selectExpr(*(f"{e} AS {c}" for c, e in JOBS))

    @property
    def bills(self) -> DataFrame:
        grouped = self.work.filter("id % 10 < 8").groupBy("month", "client_id").agg({"id": "min", "created_at": "min"})
        return grouped.withColumnsRenamed({"min(id)": "min_id", "min(created_at)": "first_at"}).selectExpr(*(f"{e} AS {c}" for c, e in BILLS))
