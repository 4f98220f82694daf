"""Row numbers over a whole relation without a task that holds it.

Rows are numbered inside buckets that follow the order, and each bucket starts
where those before it end. Only the buckets' counts, one row each, meet in one
task, so buckets are to be coarse: a prefix of a name, a month, an id by blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids of one bucket.
BLOCK = 1 << 16


def id_block(c: Column) -> Column:
    return F.floor(c / BLOCK)


def prefix(c: Column, n: int = 2) -> Column:
    return F.substring(c, 1, n)


def numbered(df: DataFrame, name: str, order: Sequence[Column | str], buckets: Sequence[Column], group: Sequence[str] = ()) -> DataFrame:
    """Add name: the row's number from 1 in order, in all rows or in each group.

    buckets must not decrease in that order, and are compared in turn.
    """
    keys = [f"__b{k}" for k in range(len(buckets))]
    rows = df.withColumns(dict(zip(keys, buckets)))
    inside = F.row_number().over(Window.partitionBy(*group, *keys).orderBy(*order))
    first = Window.partitionBy(*group).orderBy(*(F.col(k).asc_nulls_first() for k in keys)).rowsBetween(Window.unboundedPreceding, -1)
    names = [*group, *keys]
    counts = rows.groupBy(*names).agg(F.count("*").alias("__n"))
    starts = counts.select(*(F.col(c).alias(f"__s_{c}") for c in names), F.coalesce(F.sum("__n").over(first), F.lit(0)).alias("__start"))
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"__s_{c}"))
    placed = rows.withColumn("__inside", inside).join(starts, same)
    return placed.withColumn(name, (F.col("__start") + F.col("__inside")).cast("long")).select(*(c for c in df.columns if c != name), name)
