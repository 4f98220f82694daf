"""Checked sheets as JSON files: an index of them, and one file each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_INDEX = "fixtures array<struct<id:string,kind:string,image:string,gold_file:string>>"


def fixtures(spark: SparkSession, root: str) -> DataFrame:
    """(id, kind, image, gold) of the work sheets under root whose checked file is there; gold is its JSON text.

    root holds ground_truth/index.json, whose entries name files relative to root.
    """
    index = spark.read.schema(_INDEX).option("multiLine", True).json(f"{root}/ground_truth/index.json").select(F.inline("fixtures"))
    index = index.filter(F.lower(F.coalesce("kind", F.lit(""))).contains("work"))
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root)
    files = files.select(F.col("value").alias("gold"), F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))).alias("__path"))
    return index.join(files, F.col("__path").endswith(F.concat(F.lit("/"), F.col("gold_file")))).select("id", "kind", "image", "gold")
