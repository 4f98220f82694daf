"""Sinks: the work table as tab-separated text, the tax workbook as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.invoice import tax_totals

HEADER = "client\tdescription\tamount\tmonth"


def tsv_lines(lines: DataFrame) -> DataFrame:
    """(id, line) of work lines with client_name; a null amount is an empty field, nothing is quoted."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return lines.select("id", F.concat_ws("\t", text("client_name"), text("description"), text("amount"), text("month")).alias("line"))


def write_tsv(lines: DataFrame, path: str) -> None:
    """Write the table in order of id, the header first in each file's sort order."""
    head = lines.sparkSession.createDataFrame([(-1, HEADER)], "id long, line string")
    head.unionByName(tsv_lines(lines)).orderBy("id").select("line").write.text(path)


def tax_workbook(figures: DataFrame, clients: DataFrame, work: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The workbook's data rows (month, first_work, client, figures, note), and its summary rows.

    A sheet lists clients as its work lines first name them: by first_work.
    """
    names = clients.select(F.col("id").alias("__c"), F.col("name").alias("client"))
    first = work.groupBy("month", F.col("client_id").alias("client_id")).agg(F.min("id").alias("first_work"))
    rows = figures.join(names, F.col("client_id") == F.col("__c")).join(first, ["month", "client_id"])
    return rows.select("month", "first_work", "client", "revenue", "prior", "prior_taxed", "tax", "total", "note").orderBy("month", "first_work"), tax_totals(figures)
