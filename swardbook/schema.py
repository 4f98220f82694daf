"""Record schemas of the ledger. Money is decimal(12,2); months are text such as 2026-09."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

CLIENT = (
    "id long, name string, email string, phone string, address string, billing_address string, billing_notes string, "
    "mow_price decimal(12,2), hedge_price decimal(12,2), hedge_roster boolean, prefer_mail boolean, delivery string, "
    "entity_kind string, sort_order int, mowing_group string, on_roster boolean, updated_at timestamp_ntz"
)
WORK_ITEM = (
    "id long, client_id long, month string, day_or_note string, description string, amount decimal(12,2), "
    "source_job_id string, created_at timestamp_ntz"
)
UPLOAD_JOB = (
    "id string, status string, progress_msg string, extract_json string, s3_prefix string, month string, "
    "sheet_kind string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
BILL = (
    "id long, month string, client_id long, s3_key string, cover_note string, greeting string, closing string, "
    "signoff string, display_name string, bill_email string, bill_delivery string, emailed_at timestamp_ntz, created_at timestamp_ntz"
)
#: A reviewed sheet as JSON.
EXTRACT = (
    "struct<title:string,tables:array<struct<caption:string,columns:array<string>,rows:array<array<string>>>>,"
    "notes:array<string>,complete:boolean>"
)
MARK_TYPE = StructType([StructField("kind", StringType()), StructField("day", IntegerType()), StructField("name", StringType()), StructField("amount", DoubleType())])


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A relation of the given schema without rows: the state before any data."""
    return spark.createDataFrame([], schema)


def evolve(df: DataFrame, schema: str) -> DataFrame:
    """Bring older rows to a newer schema: missing columns come in as null."""
    return empty(df.sparkSession, schema).unionByName(df, allowMissingColumns=True)
