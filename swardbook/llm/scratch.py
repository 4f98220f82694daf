"""Tables written on the way, and running totals over sorted rows.

Intermediate tables go to the folder in spark.checkpoint.dir, which driver and
executors share, so a lost executor costs a re-read and nothing else. Results
are lazy and read them, so they stay until whoever holds the result is done:
``with scope(spark): ...`` deletes all that was written inside it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: What open scopes will delete: (kind, name) of folders and tables.
_scopes: list[list[tuple[str, str]]] = []


def remember(spark: SparkSession, kind: str, name: str) -> str:
    """Note a folder or table for the innermost scope, if there is one."""
    if _scopes:
        _scopes[-1].append((kind, name))
    return name


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete the folders and tables that operators write inside, at the end. Write the result before that."""
    _scopes.append([])
    try:
        yield
    finally:
        for kind, name in _scopes.pop():
            spark.sql(f"DROP TABLE IF EXISTS {name}") if kind == "table" else delete_path(spark, name)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return remember(spark, "folder", f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete through Hadoop's file systems, whatever store the folder is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Data files directly in a folder, sorted; their number is bounded by the writing tasks."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    names = [f.getPath().toString() for f in found if f.isFile()]
    return sorted(n for n in names if n.rpartition("/")[2][0] not in "._")


def stash(df: DataFrame, name: str = "stash", **options: str) -> DataFrame:
    """Write a DataFrame once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path  # type: ignore[attr-defined]
    return out


def unstash(df: DataFrame) -> None:
    """Delete a stashed table that nothing reads any more."""
    if path := getattr(df, "_stash_path", None):
        delete_path(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def same(left: DataFrame, right: DataFrame, columns: Sequence[str]):
    """Null-safe equality of columns of the same names."""
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in columns))


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[str], totals: dict[str, str]) -> DataFrame:
    """Add, for each (output, input) of totals, the sum of the input over earlier rows of the group.

    Rows are dealt by range over (group, order), so one group that holds most
    rows still spreads over all tasks. Sums per (range, group) give each range
    its start; that table has at most one row for each range and group seen in it.
    ``order`` must identify a row within its group up to rows that are equal.
    """
    n = partitions(df.sparkSession)
    dealt = stash(df.repartitionByRange(n, *group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*group, "__range").agg(*(F.sum(i).alias(f"__sum_{o}") for o, i in totals.items()))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, "__range", *(F.coalesce(F.sum(f"__sum_{o}").over(before), F.lit(0)).alias(f"__from_{o}") for o in totals))
    inside = Window.partitionBy("__range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.select("*", *(F.coalesce(F.sum(i).over(inside), F.lit(0)).alias(f"__in_{o}") for o, i in totals.items()))
    on = same(within, starts, [*group, "__range"])
    keep = [within[c] for c in df.columns]
    return within.join(starts, on, "inner").select(*keep, *((within[f"__in_{o}"] + starts[f"__from_{o}"]).alias(o) for o in totals))
