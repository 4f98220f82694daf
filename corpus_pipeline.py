"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.

Defined cases: a null or empty text fails the base rules and goes in the first
stage, so it never reaches the others; a null doc_id is kept by near-dedup, as it
names no class, and is mixed as one id; repeated rows of one doc_id are one
document to near-dedup, which keeps all of them or none, and are taken alike by
mixing; very long texts go through whole; an empty table gives no rows; further
columns of documents are carried to the last stage, whatever their names, unless
these begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from swardbook.llm import mixing, packing, quality, simhash, substrings
from swardbook.llm.scratch import delete_path, fresh_path, scope

STAGES = [
    ("quality_rules", quality.keep_good),
    ("simhash_dedup", simhash.keep_first),
    ("substring_dedup", substrings.cut_repeats),
    ("mix_sources", mixing.resample),
    ("best_fit_packing", packing.to_windows),
]

#: Fingerprints and best-fit order are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents. What a stage wrote on its way goes once its result is written, and so does the stage before it."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        with scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:
            delete_path(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
